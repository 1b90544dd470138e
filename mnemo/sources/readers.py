"""Readers of landed files: JSON lines, text, calendars, logs, manifests. Filters reach the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.text import ical_time, last_part
from mnemo.operators.frames import top

USER = "struct<login: string, avatar_url: string>"
CHAT = "type string, user string, text string, ts string, thread_ts string, subtype string, bot_id string"
PULL = f"number int, title string, body string, state string, user {USER}, created_at timestamp, updated_at timestamp, merged_at timestamp, html_url string, labels array<struct<name: string>>"
COMMENT = f"id long, body string, user {USER}, created_at timestamp, html_url string, pull_request_url string"
REVIEW = f"id long, body string, state string, user {USER}, submitted_at timestamp, html_url string"
TASK = "id string, name string, description string, status struct<status: string>, creator struct<id: string, username: string>, date_created string, date_updated string, url string"
TASK_COMMENT = "id string, comment_text string, user struct<id: string, username: string>, date string, resolved boolean, task_id string"
STATUS = "id string, task_id string, field string, before string, after string, user struct<id: string, username: string>, date string"
DOC = "id string, name string, content string, creator string, date_updated string"
POST = "id string, text string, created_at timestamp, author_id string, author_username string, author_display_name string, conversation_id string, in_reply_to_id string, retweet_count int, like_count int, reply_count int, urls array<string>"
LINE = "type string, sessionId string, slug string, timestamp timestamp, cwd string, gitBranch string, message struct<role: string, content: string>"
ENVELOPE = "id string, kind string, source string, target string, timestamp timestamp, data string, replyTo string"


def lines(spark: SparkSession, path: str, schema: str, since: Column | None = None, modified_after: str | None = None) -> DataFrame:
    """JSON lines of a declared schema; lines that do not parse are dropped here and told by `damaged`; files by
    time of change."""
    r = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    r = r.option("modifiedAfter", modified_after) if modified_after else r
    out = r.json(path)
    return out if since is None else out.where(since)


def damaged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line): what `lines` drops, so that it can be counted and kept in a table beside the good rows."""
    x = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return x.where(parsed["_corrupt_record"].isNotNull())


def chat(spark, path, oldest: str | None = None):
    return lines(spark, path, CHAT, None if oldest is None else F.col("ts").try_cast("double") > float(oldest))


def pulls(spark, path, since: str | None = None):
    return lines(spark, path, PULL, None if since is None else F.col("updated_at") > F.lit(since).cast("timestamp"))


def pull_comments(spark, path, since: str | None = None):
    own = F.contains(F.col("html_url"), F.lit("/pull/"))
    return lines(spark, path, COMMENT, own if since is None else own & (F.col("created_at") > F.lit(since).cast("timestamp")))


def reviews(spark, path, pulls_: DataFrame):
    """Reviews with the number of their pull request, of the given requests only."""
    r = lines(spark, path, REVIEW).withColumn("number", F.regexp_extract("html_url", r"/pulls?/(\d+)", 1).try_cast("int"))
    return r.join(pulls_.select("number"), "number", "left_semi")


def tasks(spark, path, since_ms: int | None = None):
    return lines(spark, path, TASK, None if since_ms is None else F.col("date_updated").try_cast("long") > since_ms)


def task_comments(spark, path):
    return lines(spark, path, TASK_COMMENT)


def status_changes(spark, path):
    return lines(spark, path, STATUS, F.col("field") == "status")


def task_docs(spark, path, since_ms: int | None = None):
    return lines(spark, path, DOC, None if since_ms is None else F.col("date_updated").try_cast("long") > since_ms)


def posts(spark, path, since: str | None = None):
    return lines(spark, path, POST, None if since is None else F.col("created_at") > F.lit(since).cast("timestamp"))


def calendar(spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Events of .ics files: unfolded lines, VEVENT blocks, one row an event with UID and DTSTART."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("calendar"), F.regexp_replace("value", "\r?\n[ \t]", "").alias("value"))
    ev = raw.select("calendar", F.explode(F.regexp_extract_all("value", F.lit("(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("e"))
    prop = lambda name: F.nullif(F.trim(F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)), F.lit(""))
    out = ev.select("calendar", prop("UID").alias("uid"), prop("SUMMARY").alias("summary"), prop("DESCRIPTION").alias("description"), ical_time(prop("DTSTART")).alias("start"), ical_time(prop("DTEND")).alias("end"), ical_time(prop("LAST-MODIFIED")).alias("modified"), prop("URL").alias("url"), F.regexp_replace(prop("ORGANIZER"), "(?i)^mailto:", "").alias("organizer"), F.transform(F.regexp_extract_all("e", F.lit(r"(?m)^ATTENDEE[^:\r\n]*:(?i:mailto:)?([^\r\n]*)"), F.lit(1)), F.trim).alias("attendees"))
    out = out.where("uid is not null and start is not null")
    out = out if since is None else out.where(F.col("start") >= since)
    return out if until is None else out.where(F.col("start") <= until)


def sessions(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """Transcript files to one row a session: first known metadata, first and last time, texts in order.

    A session without a user's message is dropped. Content that is a list counts as its text parts.
    """
    x = lines(spark, path, LINE, None, modified_after).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    parts = F.from_json("message.content", "array<struct<type: string, text: string>>")
    body = F.when(F.col("message.content").startswith("[{"), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")).otherwise(F.col("message.content"))
    x = x.withColumn("body", F.nullif(body, F.lit("")))
    at = F.struct("timestamp", "block", "n")
    texts = lambda role: F.transform(F.array_sort(F.collect_list(F.when((F.col("type") == role) & F.col("body").isNotNull(), F.struct(at.alias("at"), "body")))), lambda t: t["body"])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
    g = x.groupBy("file").agg(first("sessionId").alias("session"), first("slug").alias("slug"), first("cwd").alias("cwd"), first("gitBranch").alias("branch"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), texts("user").alias("user_texts"), texts("assistant").alias("assistant_texts"))
    return g.where(F.size("user_texts") > 0)


def session_metrics(s: DataFrame) -> DataFrame:
    """(session, summary, files, minutes): 200 characters of the first request, distinct paths, duration."""
    every = F.array_join(F.concat("user_texts", "assistant_texts"), "\n")
    paths = F.array_distinct(F.regexp_extract_all(every, F.lit(r"(?:\.{0,2}/)?[\w\-]+(?:/[\w.\-]+)+\.\w{1,5}"), F.lit(0)))
    minutes = F.round((F.unix_millis("last") - F.unix_millis("first")) / 60000).cast("long")
    return s.select("session", F.substring(F.element_at("user_texts", 1), 1, 200).alias("summary"), F.size(paths).alias("files"), minutes.alias("minutes"), F.coalesce("slug", last_part(F.col("cwd"))).alias("project"))


def commits(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Exported logs `sha|author|date|message` with an indented stat line after each commit: all of them, or the
    newest `most` of each file. A commit and its stats meet by the commit's sha carried on both lines' number."""
    raw = spark.read.text(path, lineSep="\n\n").select(F.col("_metadata.file_name").alias("repo"), F.trim("value").alias("v"))
    p = F.split(F.regexp_extract("v", r"^([^\n]*)", 1), r"\|", 4)
    stat = lambda pattern: F.coalesce(F.regexp_extract("v", pattern, 1).try_cast("int"), F.lit(0))
    x = raw.select("repo", F.get(p, 0).alias("sha"), F.get(p, 1).alias("author"), F.try_to_timestamp(F.get(p, 2)).alias("date"), F.get(p, 3).alias("message"), stat(r"(\d+) files? changed").alias("files_changed"), stat(r"(\d+) insertions?").alias("insertions"), stat(r"(\d+) deletions?").alias("deletions"))
    found = x.where((F.length("sha") >= 7) & F.col("date").isNotNull())
    return found if most is None else top(found, ["repo"], [F.desc("date"), "sha"], most)


def branches(spark: SparkSession, path: str, default: str = "main") -> DataFrame:
    """Exported `name|ahead|behind` lines."""
    p = F.split("value", r"\|")
    x = spark.read.text(path).select(F.col("_metadata.file_name").alias("repo"), F.trim(F.get(p, 0)).alias("name"), F.get(p, 1).try_cast("int").alias("ahead"), F.get(p, 2).try_cast("int").alias("behind"))
    return x.where("name <> ''").withColumn("is_default", F.col("name") == default)


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of five formats to (project, ecosystem, name, version, is_dev), the first format's entry wins."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("project"), F.col("_metadata.file_name").alias("file"), "value")
    pkg = raw.where("file = 'package.json'").select("project", F.from_json("value", "dependencies map<string, string>, devDependencies map<string, string>").alias("j"))
    js = lambda field, dev: pkg.select("project", F.explode(f"j.{field}").alias("name", "version")).select("project", F.lit("npm").alias("ecosystem"), "name", "version", F.lit(dev).alias("is_dev"), F.lit(0).alias("o"))

    def found(name: str, eco: str, section: str | None, pattern: str, order: int):
        text = F.col("value") if section is None else F.regexp_extract("value", section, 1)
        m = raw.where(F.col("file") == name).select("project", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"))
        return m.select("project", F.lit(eco).alias("ecosystem"), F.regexp_extract("m", pattern, 1).alias("name"), F.regexp_extract("m", pattern, 2).alias("version"), F.lit(False).alias("is_dev"), F.lit(order).alias("o"))

    out = js("dependencies", False).union(js("devDependencies", True))
    out = out.union(found("requirements.txt", "pypi", None, r"(?m)^\s*([A-Za-z0-9_.\-]+)[ \t]*((?:[=<>~!]=?[^#\r\n;]*)?)", 1))
    out = out.union(found("pyproject.toml", "pypi", r"(?s)dependencies\s*=\s*\[(.*?)\]", r"[\"']([A-Za-z0-9_.\-]+)\s*([^\"']*)[\"']", 2))
    out = out.union(found("Cargo.toml", "cargo", r"(?s)\[dependencies\](.*?)(?:\n\[|$)", r"(?m)^\s*([A-Za-z0-9_\-]+)\s*=\s*(.*)$", 3))
    out = out.union(found("go.mod", "go", None, r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/[^\s]+)\s+(v[^\s]+)", 4))
    return out.where("name <> ''").groupBy("project", "ecosystem", "name").agg(F.min_by(F.struct("version", "is_dev"), F.struct("o", "is_dev", "version")).alias("x")).select("project", "ecosystem", "name", F.trim("x.version").alias("version"), "x.is_dev")


#: Languages of file endings.
LANGUAGES = {"py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "rs": "Rust", "go": "Go", "java": "Java", "rb": "Ruby", "swift": "Swift", "c": "C", "cpp": "C++", "cs": "C#", "php": "PHP", "kt": "Kotlin"}


def projects(spark: SparkSession, path: str, frameworks: dict[str, str] | None = None, deps: DataFrame | None = None) -> DataFrame:
    """Folders with source files to (project, language, framework): the language of most files, the first
    framework rule whose package the project uses. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))]
    x = files.select(F.element_at(F.split("path", "/"), -2).alias("project"), lang.alias("language")).where("language is not null")
    out = x.groupBy("project", "language").count().groupBy("project").agg(F.max_by("language", F.struct("count", "language")).alias("language"))
    if frameworks and deps is not None:
        rank = F.create_map(*[y for i, k in enumerate(frameworks) for y in (F.lit(k), F.lit(i))])
        name = F.create_map(*[F.lit(y) for kv in frameworks.items() for y in kv])
        f = deps.where(F.col("name").isin(list(frameworks))).groupBy("project").agg(F.min_by(name[F.col("name")], rank[F.col("name")]).alias("framework"))
        out = out.join(f, "project", "left")
    return out


def replay(spark: SparkSession, path: str, since: str | None = None, kinds: list | None = None) -> DataFrame:
    """The event log in order of id, of some kinds, from a time on."""
    x = lines(spark, path, ENVELOPE)
    x = x if since is None else x.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return (x if kinds is None or "*" in kinds else x.where(F.col("kind").isin(kinds))).orderBy("id")


def manual_links(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {canonical, aliases} to (canonical, person_key)."""
    return spark.read.schema("canonical string, aliases array<string>").json(path, multiLine=True).select("canonical", F.explode("aliases").alias("person_key"))
