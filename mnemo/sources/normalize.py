"""Source records to the canonical record (mnemo.plans.spec.CANONICAL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions import text as T

EMPTY = "array<struct<name: string, tier: string>>"


def topics(semantic: Column, ephemeral: Column | None = None) -> Column:
    """Semantic names, then ephemeral ones that are not semantic already."""
    tag = lambda names, tier: F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("name"), F.lit(tier).alias("tier")))
    out = tag(semantic, "semantic")
    return out if ephemeral is None else F.concat(out, tag(F.array_except(ephemeral, semantic), "ephemeral"))


def record(df: DataFrame, source: str, sid, ts, kind, text, url, person, name, container, cname, ckind, topic, mentions=None, urls=None, thread=None, parent=None, avatar=None, count=None) -> DataFrame:
    none = F.lit(None).cast("string")
    strings = F.array().cast("array<string>")
    c = lambda x: F.col(x) if isinstance(x, str) else x
    key = F.concat(F.lit(f"{source}:"), c(person))
    return df.select(
        F.struct(F.lit(source).alias("source"), c(sid).cast("string").alias("source_id"), c(ts).alias("timestamp"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), T.snippet(c(text)).alias("snippet"), (none if url is None else c(url)).alias("url"), (none if thread is None else thread).alias("thread_ts"), (none if parent is None else parent.cast("string")).alias("parent_id"), (F.lit(None).cast("int") if count is None else count).alias("message_count")).alias("activity"),
        F.struct(key.alias("person_key"), F.coalesce(c(name), c(person)).alias("display_name"), F.lit(source).alias("source"), c(person).alias("source_id"), (none if avatar is None else c(avatar)).alias("avatar")).alias("person"),
        F.struct(F.lit(source).alias("source"), c(container).cast("string").alias("container_id"), c(cname).alias("name"), F.lit(ckind).alias("kind")).alias("container"),
        F.struct(F.lit(source).alias("source"), c(person).alias("account_id"), key.alias("linked_person_key")).alias("account"),
        topic.cast(EMPTY).alias("topics"), (strings if mentions is None else mentions).alias("mentions"), (strings if urls is None else urls).alias("urls"),
    )


def found_topics(text: Column, allow: list[str]) -> Column:
    return F.array_union(T.hashtags(text), T.allowed_topics(text, allow))


def chat(df: DataFrame, channel: str, allow: list[str] = ()) -> DataFrame:
    """Messages of people; a reply's parent only if its thread is another message."""
    x = df.where("user is not null and bot_id is null and coalesce(subtype, '') <> 'bot_message'")
    text = F.coalesce("text", F.lit(""))
    parent = F.when(F.col("thread_ts") != F.col("ts"), F.concat(F.lit(f"{channel}:"), "thread_ts"))
    return record(x, "slack", F.concat(F.lit(f"{channel}:"), "ts"), T.epoch_seconds(F.col("ts")), "message", text, None, "user", "user", F.lit(channel), F.lit(channel), "channel", topics(found_topics(text, allow)), T.user_mentions(text), T.urls(text), F.col("thread_ts"), parent)


def pull_request(df: DataFrame, repo: str, allow: list[str] = ()) -> DataFrame:
    text = F.concat_ws("\n", "title", "body")
    sem = found_topics(text, allow)
    labels = F.transform(F.coalesce("labels", F.array().cast("array<struct<name: string>>")), lambda x: F.lower(x["name"]))
    return record(df, "github", F.concat(F.lit(f"{repo}#"), "number"), "updated_at", "pull_request", text, "html_url", F.col("user.login"), F.col("user.login"), F.lit(repo), F.lit(repo), "repository", topics(sem, labels), T.login_mentions(text), T.urls(text), avatar=F.col("user.avatar_url"))


def pull_comment(df: DataFrame, repo: str, allow: list[str] = ()) -> DataFrame:
    text = F.coalesce("body", F.lit(""))
    n = F.regexp_extract(F.coalesce("pull_request_url", "html_url"), r"/pulls?/(\d+)", 1)
    return record(df, "github", F.concat(F.lit(f"{repo}!c"), "id"), "created_at", "pr_comment", text, "html_url", F.col("user.login"), F.col("user.login"), F.lit(repo), F.lit(repo), "repository", topics(found_topics(text, allow)), T.login_mentions(text), T.urls(text), parent=F.when(n != "", F.concat(F.lit(f"{repo}#"), n)))


def review(df: DataFrame, repo: str, allow: list[str] = ()) -> DataFrame:
    x = df.where("submitted_at is not null and not (state = 'COMMENTED' and coalesce(trim(body), '') = '')")
    text = F.concat_ws(" ", F.concat(F.lit("["), "state", F.lit("]")), F.nullif("body", F.lit("")))
    return record(x, "github", F.concat(F.lit(f"{repo}!r"), "id"), "submitted_at", "pr_review", text, "html_url", F.col("user.login"), F.col("user.login"), F.lit(repo), F.lit(repo), "repository", topics(found_topics(text, allow)), T.login_mentions(text), T.urls(text), parent=F.concat(F.lit(f"{repo}#"), F.regexp_extract("html_url", r"/pulls?/(\d+)", 1)))


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "-")


def task(df: DataFrame, board: str, allow: list[str] = ()) -> DataFrame:
    text = F.concat_ws("\n", "name", "description")
    return record(df, "clickup", "id", T.epoch_ms(F.col("date_updated")), "task", text, "url", F.col("creator.id"), F.col("creator.username"), F.lit(board), F.lit(board), "list", topics(found_topics(text, allow), F.array_compact(F.array(_slug(F.col("status.status"))))), None, T.urls(text))


def task_comment(df: DataFrame, board: str, allow: list[str] = ()) -> DataFrame:
    x = df.where("not coalesce(resolved, false) and coalesce(trim(comment_text), '') <> ''")
    return record(x, "clickup", F.concat(F.lit("comment:"), "id"), T.epoch_ms(F.col("date")), "task_comment", "comment_text", None, F.col("user.id"), F.col("user.username"), F.lit(board), F.lit(board), "list", topics(found_topics(F.col("comment_text"), allow)), None, T.urls(F.col("comment_text")), parent=F.col("task_id"))


def status_change(df: DataFrame, board: str) -> DataFrame:
    text = F.concat_ws(" ", F.lit("Status:"), "before", F.lit("to"), "after")
    return record(df, "clickup", F.concat(F.lit("status:"), "id"), T.epoch_ms(F.col("date")), "status_change", text, None, F.col("user.id"), F.col("user.username"), F.lit(board), F.lit(board), "list", topics(F.array().cast("array<string>"), F.array_compact(F.array(_slug(F.col("before")), _slug(F.col("after"))))), parent=F.col("task_id"))


def doc(df: DataFrame, space: str, allow: list[str] = ()) -> DataFrame:
    text = F.concat_ws("\n", "name", "content")
    return record(df, "clickup", F.concat(F.lit("doc:"), "id"), T.epoch_ms(F.col("date_updated")), "doc", text, None, "creator", "creator", F.lit(space), F.lit(space), "space", topics(found_topics(text, allow)), None, T.urls(text))


def event(df: DataFrame, owner: str, allow: list[str] = ()) -> DataFrame:
    """Calendar events; without an organiser the owner counts; without a start the row goes."""
    text = F.concat_ws("\n", "summary", "description")
    who = F.coalesce("organizer", F.lit(owner))
    return record(df.where("start is not null"), "apple-calendar", "uid", "start", "calendar_event", text, "url", who, who, "calendar", "calendar", "calendar", topics(found_topics(text, allow)), F.col("attendees"), T.urls(text))


def post(df: DataFrame, allow: list[str] = ()) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return record(df, "twitter", "id", "created_at", F.when(F.col("in_reply_to_id").isNotNull(), "reply").otherwise("tweet"), text, F.concat(F.lit("https://twitter.com/"), "author_username", F.lit("/status/"), "id"), "author_id", F.coalesce("author_display_name", "author_username"), F.coalesce("conversation_id", "id"), F.col("author_username"), "conversation", topics(found_topics(text, allow)), T.handle_mentions(text), F.array_union(T.urls(text), F.coalesce("urls", F.array().cast("array<string>"))), parent=F.col("in_reply_to_id"))


def fallback_summary() -> Column:
    """A templated summary of a session: header, start of the first request, end of the last."""
    n = F.size("user_texts")
    tail = F.element_at("user_texts", -1)
    return F.concat_ws("\n", F.concat(F.lit("Session in "), F.coalesce("cwd", F.lit("unknown")), F.lit(" ("), n.cast("string"), F.lit(" requests)")), F.concat(F.lit("First request: "), F.substring(F.element_at("user_texts", 1), 1, 500)), F.when(n > 1, F.concat(F.lit("Last request: "), F.when(F.length(tail) > 300, F.right(tail, F.lit(300))).otherwise(tail))))


def transcript(most: int = 12_000) -> Column:
    pairs = F.arrays_zip("user_texts", "assistant_texts")
    turn = F.transform(pairs, lambda p: F.concat_ws("\n", F.concat(F.lit("User: "), p["user_texts"]), F.concat(F.lit("Assistant: "), p["assistant_texts"])))
    return F.substring(F.array_join(turn, "\n"), 1, most)


def session(df: DataFrame, allow: list[str] = ()) -> DataFrame:
    text = fallback_summary()
    sem = F.array_union(T.topics_line(text), T.allowed_topics(text, allow))
    eph = F.array_compact(F.array(F.lower(T.last_part(F.coalesce("slug", F.lit("")))), F.lower("branch")))
    return record(df, "assistant", "session", "last", "session", text, None, F.lit("me"), F.lit("me"), F.coalesce("cwd", F.lit("unknown")), T.last_part(F.coalesce("cwd", F.lit(""))), "project", topics(sem, eph), count=F.size("user_texts") + F.size("assistant_texts"))


KINDS = ["decision", "insight", "bug_fix", "preference", "session_summary"]


def memory(df: DataFrame, who: str = "me") -> DataFrame:
    """Snippets (content, kind, topics, ts) of the allowed kinds; the id is time and content hash."""
    sid = F.concat_ws("-", F.unix_millis("ts").cast("string"), T.content_id(F.col("content")))
    return record(df.where(F.col("kind").isin(KINDS)), "memory", sid, "ts", F.col("kind"), "content", None, F.lit(who), F.lit(who), F.lit("memory"), F.lit("memory"), "memory", topics(F.transform("topics", lambda t: F.lower(F.trim(t)))))


def graph_tables(canonical: DataFrame) -> dict[str, DataFrame]:
    """A batch of canonical records to node and edge tables, deduplicated: activities keep the first of their
    key, everything else the last by time."""
    a = canonical.withColumn("ts", F.col("activity.timestamp")).withColumn("sid", F.struct("activity.source", "activity.source_id"))
    last = lambda df, keys: df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("ts", *keys)]), "ts").alias("x")).select(*keys, "x.*") if [c for c in df.columns if c not in ("ts", *keys)] else df.select(*keys).distinct()
    act = canonical.groupBy("activity.source", "activity.source_id").agg(F.min_by("activity", F.struct("activity.timestamp", "activity.snippet")).alias("a")).select("a.*")
    tp = a.select("ts", "sid", F.explode("topics").alias("t")).select("ts", "sid", "t.name", "t.tier")
    edge = lambda c: a.select("sid", *c).distinct()
    return {
        "activities": act,
        "persons": last(a.select("ts", "person.*"), ["person_key"]),
        "topics": last(tp.select("ts", "name", "tier"), ["name"]),
        "containers": last(a.select("ts", "container.*"), ["source", "container_id"]),
        "accounts": last(a.select("ts", "account.*"), ["source", "account_id"]),
        "from_person": edge(["person.person_key"]),
        "in_container": edge(["container.container_id"]),
        "mentions": tp.select("sid", "name").distinct(),
        "mentions_person": a.select("sid", F.explode("mentions").alias("mention")).distinct(),
        "replies_to": a.where("activity.parent_id is not null").select("sid", F.struct("activity.source", F.col("activity.parent_id").alias("source_id")).alias("parent")).distinct(),
        "owns": a.select("account.source", "account.account_id", "sid").distinct(),
        "identifies": a.groupBy("person.person_key", "account.account_id").agg(F.min("ts").alias("first_seen")),
    }
