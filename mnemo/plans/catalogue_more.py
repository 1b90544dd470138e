"""Further registered queries: normalised sources, text tools, writes, resolution, maintenance, recall.

Each takes whole tables, as in mnemo.plans.catalogue, and has SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.operators import clinical, frames, graph, maintain, portfolio, recall, research, resolve, search, sinks
from mnemo.plans.catalogue import CLIN, at, next_orders, query, touches
from mnemo.plans.roles import AS_OF_EVENTS, AS_OF_ORDERS, Tables
from mnemo.plans.spec import GENERAL
from mnemo.sources import normalize


def ntz(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


# ---------------------------------------------------------------- sources to canonical records


def flat(records: DataFrame) -> DataFrame:
    """The canonical record's main fields as plain columns."""
    tag = F.array_join(F.transform("topics", lambda x: F.concat_ws("/", x["name"], x["tier"])), ",")
    return records.select(F.col("activity.source_id").alias("source_id"), ntz("activity.timestamp").alias("ts"), F.col("activity.kind").alias("kind"), F.col("activity.snippet").alias("snippet"), F.col("activity.parent_id").alias("parent_id"), F.col("person.person_key").alias("person_key"), F.col("container.container_id").alias("container_id"), tag.alias("topics"))


SNIP = "CASE WHEN length({0}) > 2000 THEN substr({0}, 1, 2000) || '…' ELSE {0} END"


@query("chat_records", f"""WITH m AS (SELECT *, (1700000000 + conv_id) || '.' || lpad(turn::VARCHAR, 6, '0') AS stamp, (1700000000 + conv_id) || '.000000' AS thread FROM conversations WHERE role <> 'assistant')
  SELECT 'general:' || stamp AS source_id, make_timestamp((1700000000 + conv_id) * 1000000 + turn) AS ts, 'message' AS kind, {SNIP.format("coalesce(text, '')")} AS snippet, CASE WHEN thread <> stamp THEN 'general:' || thread END AS parent_id, 'slack:' || role AS person_key, 'general' AS container_id,
    coalesce(list_aggregate(list_transform(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?:^|\\s)#(\\w{{2,}})', 1), lambda s: lower(s))), lambda s: s || '/semantic'), 'string_agg', ','), '') AS topics FROM m""")
def _(t):
    at_ = F.col("conv_id") + 1_700_000_000
    c = t.raw("conversations").select(F.col("role").alias("user"), F.when(F.col("role") == "assistant", "b1").alias("bot_id"), F.lit(None).cast("string").alias("subtype"), F.concat(at_.cast("string"), F.lit("."), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("ts"), F.concat(at_.cast("string"), F.lit(".000000")).alias("thread_ts"), "text")
    return flat(normalize.chat(c, "general"))


@query("pull_request_records", """SELECT 'repo#' || o_orderkey AS source_id, o_orderdate AS ts, 'pull_request' AS kind, o_orderpriority || chr(10) || '#Clerk' || (o_custkey % 9) || ' asks @C' || o_custkey AS snippet, NULL::VARCHAR AS parent_id, 'github:c' || o_custkey AS person_key, 'repo' AS container_id, 'clerk' || (o_custkey % 9) || '/semantic,' || lower(o_orderstatus) || '/ephemeral' AS topics FROM orders""")
def _(t):
    x = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("number"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("#Clerk"), F.col("o_custkey") % 9, F.lit(" asks @C"), "o_custkey").alias("body"), F.col("o_orderdate").alias("updated_at"), F.lit("u").alias("html_url"), F.array(F.struct(F.col("o_orderstatus").alias("name"))).alias("labels"), F.struct(F.concat(F.lit("c"), "o_custkey").alias("login"), F.lit("a").alias("avatar_url")).alias("user"))
    return flat(normalize.pull_request(x, "repo"))


@query("comment_records", """SELECT 'repo!c' || l_orderkey || '-' || l_linenumber AS source_id, l_shipdate AS ts, 'pr_comment' AS kind, 'ships ' || l_returnflag AS snippet, 'repo#' || l_orderkey AS parent_id, 'github:s' || l_suppkey AS person_key, 'repo' AS container_id, '' AS topics FROM lineitem""")
def _(t):
    x = t.raw("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("ships "), "l_returnflag").alias("body"), F.concat(F.lit("https://h/pulls/"), "l_orderkey").alias("pull_request_url"), F.lit("https://h/c").alias("html_url"), F.col("l_shipdate").alias("created_at"), F.struct(F.concat(F.lit("s"), "l_suppkey").alias("login"), F.lit("a").alias("avatar_url")).alias("user"))
    return flat(normalize.pull_comment(x, "repo"))


@query("review_records", """SELECT 'repo!r' || event_id AS source_id, ts, 'pr_review' AS kind, CASE WHEN event_type = 'click' THEN '[COMMENTED]' ELSE '[' || upper(event_type) || ']' END || ' ' || props AS snippet, 'repo#' || (event_id % 1000) AS parent_id, 'github:u' || user_id AS person_key, 'repo' AS container_id, '' AS topics FROM events WHERE NOT (event_type = 'click' AND user_id % 3 = 0)""")
def _(t):
    click = F.col("event_type") == "click"
    x = t.raw("events").select(F.col("event_id").cast("string").alias("id"), F.when(click & (F.col("user_id") % 3 == 0), " ").otherwise(F.col("props")).alias("body"), F.when(click, "COMMENTED").otherwise(F.upper("event_type")).alias("state"), F.col("ts").alias("submitted_at"), F.concat(F.lit("https://h/pull/"), F.col("event_id") % 1000).alias("html_url"), F.struct(F.concat(F.lit("u"), "user_id").alias("login"), F.lit("a").alias("avatar_url")).alias("user"))
    return flat(normalize.review(x, "repo"))


def millis() -> Column:
    return (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long").cast("string")


@query("task_records", """SELECT o_orderkey::VARCHAR AS source_id, o_orderdate AS ts, 'task' AS kind, o_orderpriority || chr(10) || 'for #Team' || (o_custkey % 5) AS snippet, NULL::VARCHAR AS parent_id, 'clickup:' || o_custkey AS person_key, 'board' AS container_id, 'team' || (o_custkey % 5) || '/semantic,in-' || lower(o_orderstatus) || '/ephemeral' AS topics FROM orders""")
def _(t):
    who = F.col("o_custkey").cast("string")
    x = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("for #Team"), F.col("o_custkey") % 5).alias("description"), millis().alias("date_updated"), F.lit("u").alias("url"), F.struct(who.alias("id"), who.alias("username")).alias("creator"), F.struct(F.concat(F.lit("In  "), "o_orderstatus").alias("status")).alias("status"))
    return flat(normalize.task(x, "board"))


@query("status_changes", """SELECT 'status:' || o_orderkey AS source_id, o_orderdate AS ts, 'status_change' AS kind, 'Status: To Do to ' || o_orderstatus AS snippet, (o_orderkey % 100)::VARCHAR AS parent_id, 'clickup:' || o_custkey AS person_key, 'board' AS container_id, 'to-do/ephemeral,' || lower(o_orderstatus) || '/ephemeral' AS topics FROM orders""")
def _(t):
    who = F.col("o_custkey").cast("string")
    x = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("To Do").alias("before"), F.col("o_orderstatus").alias("after"), millis().alias("date"), (F.col("o_orderkey") % 100).cast("string").alias("task_id"), F.struct(who.alias("id"), who.alias("username")).alias("user"))
    return flat(normalize.status_change(x, "board"))


@query("task_comments", f"""SELECT 'comment:' || conv_id || '-' || turn AS source_id, make_timestamp((1700000000 + conv_id) * 1000000) AS ts, 'task_comment' AS kind, {SNIP.format("text")} AS snippet, conv_id::VARCHAR AS parent_id, 'clickup:' || role AS person_key, 'board' AS container_id, coalesce(list_aggregate(list_transform(list_distinct(list_transform(regexp_extract_all(text, '(?:^|\\s)#(\\w{{2,}})', 1), lambda s: lower(s))), lambda s: s || '/semantic'), 'string_agg', ','), '') AS topics FROM conversations WHERE turn % 4 <> 3 AND coalesce(trim(text), '') <> ''""")
def _(t):
    x = t.raw("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), ((F.col("conv_id") + 1_700_000_000) * 1000).cast("string").alias("date"), F.col("text").alias("comment_text"), (F.col("turn") % 4 == 3).alias("resolved"), F.col("conv_id").cast("string").alias("task_id"), F.struct(F.col("role").alias("id"), F.col("role").alias("username")).alias("user"))
    return flat(normalize.task_comment(x, "board"))


@query("calendar_records", """SELECT 'e' || event_id AS source_id, ts, 'calendar_event' AS kind, event_type || chr(10) || props AS snippet, NULL::VARCHAR AS parent_id, 'apple-calendar:' || CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 'owner' END AS person_key, 'calendar' AS container_id, '' AS topics FROM events WHERE event_type <> 'error'""")
def _(t):
    x = t.raw("events").select(F.concat(F.lit("e"), "event_id").alias("uid"), F.when(F.col("event_type") != "error", F.col("ts")).alias("start"), F.col("event_type").alias("summary"), F.col("props").alias("description"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), "user_id")).alias("organizer"), F.lit("u").alias("url"), F.lit("calendar").alias("calendar"), F.array(F.lit("x")).alias("attendees"))
    return flat(normalize.event(x, "owner"))


@query("post_records", """SELECT 'p' || page_id AS source_id, make_timestamp(1700000000000000 + page_id) AS ts, CASE WHEN page_id % 3 = 0 THEN 'reply' ELSE 'tweet' END AS kind, 'see ' || url || ' by @Web' || (page_id % 7) AS snippet, CASE WHEN page_id % 3 = 0 THEN 'p' || (page_id - 1) END AS parent_id, 'twitter:' || (page_id % 11) AS person_key, 'p' || page_id AS container_id, '' AS topics FROM pages""")
def _(t):
    n, none = F.col("page_id"), F.lit(None).cast("string")
    x = t.raw("pages").select(F.concat(F.lit("p"), n).alias("id"), F.timestamp_micros(n + 1_700_000_000_000_000).alias("created_at"), F.concat(F.lit("see "), "url", F.lit(" by @Web"), n % 7).alias("text"), (n % 11).cast("string").alias("author_id"), F.lit("a").alias("author_username"), none.alias("author_display_name"), none.alias("conversation_id"), F.when(n % 3 == 0, F.concat(F.lit("p"), n - 1)).alias("in_reply_to_id"), F.array("url").alias("urls"))
    return flat(normalize.post(x))


@query("memory_records", f"""SELECT ((1700000000 + conv_id) * 1000) || '-' || substr(sha256(text), 1, 12) AS source_id, make_timestamp((1700000000 + conv_id) * 1000000) AS ts, 'insight' AS kind, {SNIP.format("text")} AS snippet, NULL::VARCHAR AS parent_id, 'memory:me' AS person_key, 'memory' AS container_id, role || '/semantic' AS topics FROM conversations WHERE turn % 2 = 1""")
def _(t):
    x = t.raw("conversations").select(F.col("text").alias("content"), F.when(F.col("turn") % 2 == 1, "insight").otherwise("chatter").alias("kind"), F.array(F.concat(F.lit(" "), F.upper("role"))).alias("topics"), F.timestamp_seconds(F.col("conv_id") + 1_700_000_000).alias("ts"))
    return flat(normalize.memory(x))


@query("semantic_topics", "SELECT DISTINCT 'team' || (o_custkey % 5) AS name, 'semantic' AS tier FROM orders")
def _(t):
    x = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("number"), F.lit("t").alias("title"), F.concat(F.lit("#Team"), F.col("o_custkey") % 5).alias("body"), F.col("o_orderdate").alias("updated_at"), F.lit("u").alias("html_url"), F.array(F.struct(F.col("o_orderstatus").alias("name"))).alias("labels"), F.struct(F.lit("c").alias("login"), F.lit("a").alias("avatar_url")).alias("user"))
    return normalize.graph_tables(normalize.pull_request(x, "repo"))["topics"].where("tier = 'semantic'").select("name", "tier")


# ---------------------------------------------------------------- text, numbers and scores


@query("text_tools", """SELECT page_id, '@user' || page_id || ',@x' AS source, list_aggregate(list_sort(list_distinct(['user' || page_id, 'x'])), 'string_agg', ',') AS logins, 'red ' || page_id AS plain, 'path-to-' || page_id AS slug, page_id::VARCHAR AS last, url LIKE '%/1%' OR url LIKE '%org%' AS keyword, length(page_id::VARCHAR) BETWEEN 5 AND 20 AS code, 'k' || page_id AS stripped, 'n' || page_id || ': ' || page_id || ' activities; related: a, b' AS fact, list_aggregate(['a', 'b' || page_id], 'string_agg', ',') AS topics, '{"id":' || page_id || '}' AS json, make_timestamp(1700000000000000 + (page_id % 86400) * 1000000) AS ical FROM pages""")
def _(t):
    n = F.col("page_id").cast("string")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 86400), "yyyyMMdd'T'HHmmss'Z'")
    x = t.raw("pages").select("page_id", "url", n.alias("n"), stamp.alias("stamp"))
    tick = "```"
    return x.select(
        "page_id",
        F.concat(F.lit("@user"), "n", F.lit(",@x")).alias("source"),
        F.array_join(F.array_sort(T.login_mentions(F.concat(F.lit("by @User"), "n", F.lit(" and @x @X")))), ",").alias("logins"),
        T.strip_ansi(F.concat(F.lit("\x1b[31mred \x1b[0m"), "n")).alias("plain"),
        F.concat(F.lit("path-to-"), "n").alias("slug"),
        T.last_part(F.concat(F.lit("-path-to-"), "n")).alias("last"),
        T.keyword_hit(F.col("url"), ["/1", "ORG"]).alias("keyword"),
        T.is_code(F.col("n")).alias("code"),
        T.strip_source(F.concat(F.lit("src:k"), "n")).alias("stripped"),
        T.fact_sentence(F.concat(F.lit("n"), "n"), F.col("page_id"), F.array(F.lit("a"), F.lit("b"))).alias("fact"),
        F.array_join(T.topics_line(F.concat(F.lit("Done.\nTopics: A, b"), "n", F.lit(", a\n"))), ",").alias("topics"),
        T.json_candidate(F.concat(F.lit(f"Here:\n{tick}json\n{{\"id\":"), "n", F.lit(f"}}\n{tick}\nDone"))).alias("json"),
        ntz(T.ical_time(F.col("stamp"))).alias("ical"),
    )


@query("score_tools", """SELECT o_orderkey, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - ((epoch_us(TIMESTAMP '2001-01-01') - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE) / 365.0::DOUBLE)), 6) AS recency, (o_orderstatus = 'F')::INT::DOUBLE AS same, round(((o_orderstatus = 'F')::INT * 0.35::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE) / 0.65::DOUBLE, 6) AS mean, round(1 / (1 + 0.01::DOUBLE * (o_custkey % 50)), 6) AS saturation, CASE WHEN o_custkey % 3 = 0 THEN 'rising' WHEN o_custkey % 3 = 1 THEN 'falling' ELSE 'stable' END AS direction, length(o_orderkey::VARCHAR) = 26 AS ulid FROM orders""")
def _(t):
    o = t.raw("orders")
    same = T.type_match(F.col("o_orderstatus"), F.lit("F"))
    delta = F.when(F.col("o_custkey") % 3 == 0, 1.0).when(F.col("o_custkey") % 3 == 1, -1.0).otherwise(0.0)
    return o.select("o_orderkey", F.round(T.linear_recency(at(AS_OF_ORDERS), F.col("o_orderdate")), 6).alias("recency"), same.alias("same"), F.round(T.weighted_mean({"a": same, "b": F.lit(0.5)}, {"a": 0.35, "b": 0.3}), 6).alias("mean"), F.round(T.access_saturation(F.col("o_custkey") % 50), 6).alias("saturation"), T.direction(delta).alias("direction"), T.is_ulid(F.col("o_orderkey").cast("string")).alias("ulid"))


@query("cosine_to_first", """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS xy, list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE)) AS xx, list_sum(list_transform(v, lambda z: z::DOUBLE * z::DOUBLE)) AS yy FROM embeddings, q) SELECT vec_id, round(xy / (sqrt(xx) * sqrt(yy)), 4) AS cosine FROM d""")
def _(t):
    e = t.raw("embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("v"))  # one row
    return e.join(F.broadcast(first)).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("v")), 4).alias("cosine"))


# ---------------------------------------------------------------- writes


def new_atoms(t: Tables) -> dict[str, DataFrame]:
    x = t.raw("orders").select(F.col("o_orderpriority").alias("content"), F.lit("note").alias("kind"), F.lit("high").alias("salience"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("e"), F.col("o_custkey") % 9)).alias("episode"), F.when(F.col("o_custkey") % 3 == 0, F.lit("old")).alias("supersedes"), F.col("o_orderkey").cast("string").alias("instance"), F.lit("/w").alias("cwd"))
    return sinks.write_atoms(x, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))


ATOM_ID = "substr(sha256(o_orderkey || '|/w|' || o_orderpriority || '|2001-01-01 00:00:00'), 1, 26)"


@query("written_atoms", f"SELECT {ATOM_ID} AS atom, o_orderpriority AS content, false AS extracted, 0::BIGINT AS access_count FROM orders")
def _(t):
    return new_atoms(t)["atoms"].select("atom", "content", "extracted", "access_count")


@query("written_edges", f"SELECT 'in_episode' AS kind, {ATOM_ID} AS atom, 'e' || (o_custkey % 9) AS other FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 'supersedes', {ATOM_ID}, 'old' FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT 'job', {ATOM_ID}, '0' FROM orders")
def _(t):
    x = new_atoms(t)
    one = lambda k, c: x[k].select(F.lit(k.removesuffix("s") if k == "jobs" else k).alias("kind"), "atom", F.col(c).cast("string").alias("other"))
    return one("in_episode", "episode").union(one("supersedes", "prior")).union(one("jobs", "attempts"))


@query("occurrences", "SELECT atom, entity, 'old' AS kind FROM mentions WHERE prominence >= 25 UNION ALL SELECT atom, entity, 'new' FROM mentions", "mentions")
def _(t):
    m = t.mentions()
    old = m.where("prominence >= 25").select("atom", "entity", F.lit("old").alias("kind"))
    return sinks.create_occurrences(old, m.select("atom", "entity", F.lit("new").alias("kind")).union(old))


@query("cleared_graph", "SELECT 'node' AS what, p_partkey::VARCHAR AS id FROM part UNION ALL SELECT 'edge', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0")
def _(t):
    nodes = t.raw("part").select(F.lit("Part").alias("label"), F.col("p_partkey").cast("string").alias("id")).union(t.raw("customer").select(F.lit("Person"), F.col("c_custkey").cast("string")))
    e = t.raw("lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "Part").otherwise("Person").alias("src_label"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("src"), F.lit("Part").alias("dst_label"), F.lit("x").alias("dst"))
    n, left = sinks.cleared(nodes, e, ["Person"])
    return n.select(F.lit("node").alias("what"), "id").union(left.select(F.lit("edge"), "src"))


def instances(t: Tables) -> DataFrame:
    return t.raw("supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("nation "), "s_nationkey").alias("description"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") % 4).cast("string"), 9, "0"))).alias("parent"), F.lit("active").alias("status"), at("2000-01-01").alias("created_at"))


@query("registry", "SELECT s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'removed' ELSE 'active' END AS status, 'nation ' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ' b' ELSE '' END AS description FROM supplier")
def _(t):
    x = instances(t)
    key = t.raw("supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    again = x.join(key.where("s_suppkey % 2 = 0"), "name").select("name", F.concat("description", F.lit(" b")).alias("description"), "parent", "created_at")
    out = sinks.unregister(sinks.register(x, again), key.where("s_suppkey % 5 = 0"))
    return out.select("name", "status", "description")


@query("instance_parents", "WITH x AS (SELECT s_name AS name, CASE WHEN s_suppkey % 4 > 0 THEN 'Supplier#' || lpad((s_suppkey % 4)::VARCHAR, 9, '0') END AS parent FROM supplier) SELECT x.parent AS src, x.name AS dst FROM x SEMI JOIN x y ON y.name = x.parent")
def _(t):
    return sinks.parents(instances(t))


@query("recent_per_instance", "SELECT instance, source_id FROM (SELECT person AS instance, source_id, row_number() OVER (PARTITION BY person ORDER BY ts DESC, source_id) AS r FROM activities) WHERE r <= 5", "activities")
def _(t):
    return sinks.recent_per_instance(t.activities().withColumnRenamed("person", "instance"), 5).select("instance", "source_id")


@query("ingest_report", "SELECT 'count' AS section, 'orders' AS name, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'count', 'events', count(*)::VARCHAR FROM events UNION ALL SELECT 'cursor', 'events:' || event_type, strftime(max(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') FROM events GROUP BY event_type")
def _(t):
    seen = t.activities().select("source", F.col("kind").alias("container"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return sinks.status({n: t.raw(n) for n in ("orders", "events")}, maintain.cursors(seen))


@query("run_record", "SELECT 'tiers' AS pass, TIMESTAMP '2001-01-01' AS run_at, '[{\"n\":' || count(*) || '}]' AS stats FROM orders")
def _(t):
    return sinks.run_record("tiers", t.raw("orders").agg(F.count("*").alias("n")), at(AS_OF_ORDERS))


# ---------------------------------------------------------------- resolution and maintenance


def extractions(t: Tables) -> DataFrame:
    m = t.mentions()
    return m.select("atom", F.concat_ws("-", "atom", "entity").alias("mention"), F.when(F.col("entity") % 10 == 0, " ").otherwise(F.concat(F.lit("n"), "entity")).alias("name"), F.lit("part").alias("type"), F.when(F.col("entity") % 7 > 0, F.col("prominence") / 50).alias("prominence"), "entity")


EXTRACTED = "x AS (SELECT atom, entity, CASE WHEN entity % 7 > 0 THEN prominence / 50::DOUBLE ELSE 0.5::DOUBLE END AS prominence FROM mentions WHERE entity % 10 <> 0)"


def written(t: Tables) -> dict[str, DataFrame]:
    x = extractions(t)
    resolved = x.select("mention", "entity", F.when(F.col("entity") % 11 == 0, F.col("entity") - 1).alias("alias_of"), F.lit(0.7).alias("fit"))
    return resolve.extraction_writes(x.drop("entity"), resolved, t.atoms())


@query("extracted_mentions", f"WITH {EXTRACTED} SELECT atom, entity, prominence FROM x", "mentions")
def _(t):
    return written(t)["mentions"].select("atom", "entity", "prominence")


@query("extracted_associations", f"WITH {EXTRACTED} SELECT x.entity AS a, y.entity AS b, count(*) AS weight, max(created_at) AS last_reinforced FROM x JOIN x y ON x.atom = y.atom AND x.entity < y.entity JOIN atoms ON atoms.atom = x.atom GROUP BY ALL", "mentions", "atoms")
def _(t):
    return written(t)["assoc"]


@query("extracted_bumps", f"WITH {EXTRACTED} SELECT entity, count(*) AS mention_count, max(created_at) AS last_seen FROM x JOIN atoms USING (atom) GROUP BY 1", "mentions", "atoms")
def _(t):
    return written(t)["entity_bumps"]


@query("suspected_aliases", "SELECT DISTINCT entity AS a, entity - 1 AS b, 0.7::DOUBLE AS confidence, 'suspected' AS status FROM mentions WHERE entity % 11 = 0", "mentions")
def _(t):
    return written(t)["aliases"].withColumn("confidence", F.col("confidence").cast("double"))


def fit_pairs(t: Tables) -> DataFrame:
    """Each part against the one with the next key."""
    e = t.raw("part").select(F.col("p_partkey").alias("mention"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    o = t.raw("part").select((F.col("p_partkey") - 1).alias("mention"), F.col("p_partkey").cast("string").alias("entity"), F.col("p_name").alias("entity_name"), F.col("p_type").alias("entity_type"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size").cast("int")).cast("timestamp_ntz").alias("last_seen"), (F.col("p_size") / 50).alias("overlap"), (F.col("p_size") % 2).alias("place"))
    return e.join(o, "mention")


SIM = """tk AS (SELECT p_partkey, p_name, p_type, p_size, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS t, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 2))) AS b FROM part),
  f AS (SELECT x.p_partkey AS mention, x.p_name AS name, x.p_type AS type, y.p_partkey::VARCHAR AS entity, round((0.35::DOUBLE * least(1.0::DOUBLE, 0.7::DOUBLE * len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) + 0.3::DOUBLE * len(list_intersect(x.b, y.b)) / len(list_distinct(list_concat(x.b, y.b)))) + 0.15::DOUBLE * (1 - (366 - y.p_size) / 365.0::DOUBLE).greatest(0.0::DOUBLE) + 0.30::DOUBLE * (y.p_size / 50.0::DOUBLE) + 0.10::DOUBLE * (x.p_type = y.p_type)::INT + 0.10::DOUBLE * (y.p_size % 2)) / 1.0::DOUBLE, 6) AS fit FROM tk x JOIN tk y ON y.p_partkey = x.p_partkey + 1)"""


@query("fit_scores", f"WITH {SIM} SELECT mention, entity, fit FROM f")
def _(t):
    return resolve.fit(fit_pairs(t), GENERAL, at(AS_OF_ORDERS)).select("mention", "entity", "fit")


@query("resolved_names", f"""WITH {SIM}, n AS (SELECT p_partkey AS mention, p_name AS name, p_type AS type FROM part),
  known AS (SELECT p_name AS name, p_type AS type, min(p_partkey::VARCHAR) AS entity FROM part WHERE p_size > 40 GROUP BY 1, 2)
  SELECT mention, CASE WHEN k.entity IS NOT NULL THEN k.entity WHEN fit >= {GENERAL.accept} THEN f.entity ELSE substr(sha256(lower(n.name) || '|' || n.type), 1, 26) END AS entity, CASE WHEN k.entity IS NOT NULL THEN 'exact' WHEN fit >= {GENERAL.accept} THEN 'accept' WHEN fit >= {GENERAL.uncertain} THEN 'suspect' ELSE 'new' END AS decision, CASE WHEN k.entity IS NULL AND fit >= {GENERAL.uncertain} AND fit < {GENERAL.accept} THEN f.entity END AS alias_of
  FROM n LEFT JOIN known k ON k.name = n.name AND k.type = n.type LEFT JOIN f USING (mention)""")
def _(t):
    names = t.raw("part").select(F.col("p_partkey").alias("mention"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    known = t.raw("part").where("p_size > 40").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return resolve.resolve(names, known, fit_pairs(t), at(AS_OF_ORDERS)).select("mention", "entity", "decision", "alias_of")


@query("jobs_due", "SELECT o_orderkey AS atom, 'due' AS state FROM orders WHERE o_custkey % 7 < 5 AND o_orderdate <= TIMESTAMP '1999-01-01' UNION ALL SELECT o_orderkey, 'given up' FROM orders WHERE o_custkey % 7 >= 5")
def _(t):
    o = t.raw("orders")
    a = o.select(F.col("o_orderkey").alias("atom"), F.lit(False).alias("extracted"))
    tries = o.select(F.col("o_orderkey").alias("atom"), (F.col("o_custkey") % 7).alias("attempts"), F.col("o_orderdate").alias("next_at"))
    due, given_up = resolve.due(a, tries, at("1999-01-01"))
    return due.select("atom", F.lit("due").alias("state")).union(given_up.select("atom", F.lit("given up")))


def alias_rows(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), (F.col("p_size") / 50).alias("confidence"), F.when(F.col("p_size") % 2 == 0, "suspected").otherwise("confirmed").alias("status"), F.date_add(F.lit("2000-12-20").cast("date"), F.col("p_size").cast("int")).cast("timestamp_ntz").alias("created_at"))


@query("alias_candidates", "SELECT p_partkey AS a, p_partkey + 1 AS b, p_size / 50::DOUBLE AS confidence FROM part WHERE p_size % 2 = 0 AND DATE '2000-12-20' + p_size::INT <= TIMESTAMP '2000-12-31 23:55:00' AND p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey + 1 IN (SELECT l_partkey FROM lineitem) ORDER BY confidence DESC, a LIMIT 20")
def _(t):
    e = t.raw("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("mention_count"))
    return maintain.alias_candidates(alias_rows(t), e, at(AS_OF_ORDERS)).select("a", "b", "confidence")


@query("alias_evidence", "SELECT entity, atom, rank, substr(content, 1, 3) AS content FROM (SELECT entity, atom, salience AS content, row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, atom) AS rank FROM mentions JOIN atoms USING (atom)) WHERE rank <= 3", "mentions", "atoms")
def _(t):
    return maintain.evidence(t.mentions(), t.atoms().withColumnRenamed("salience", "content"), t.entities(), 3, 3).select("entity", "atom", "rank", "content")


@query("collapsed_entities", """WITH c AS (SELECT p_partkey AS id, p_name AS name, p_type, p_size AS n, min(p_partkey) OVER (PARTITION BY p_type) AS root FROM part), g AS (SELECT root, sum(n)::BIGINT AS mention_count, list_aggregate(list_sort(list(DISTINCT name)), 'string_agg', ',') AS names FROM c GROUP BY 1)
  SELECT id, CASE WHEN id = c.root THEN 'active' ELSE 'merged' END AS status, CASE WHEN id = c.root THEN mention_count ELSE n END AS mention_count, CASE WHEN id = c.root THEN names END AS names FROM c JOIN g ON g.root = c.root""")
def _(t):
    e = t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("mention_count"), at("2000-01-01").alias("last_seen"), F.lit(None).cast("array<string>").alias("aliases"), F.lit("active").alias("status"))
    head = t.raw("part").groupBy("p_type").agg(F.min("p_partkey").alias("root"))
    root = t.raw("part").join(head, "p_type").where("p_partkey <> root").select(F.col("p_partkey").alias("entity"), "root")
    out = maintain.collapse_entities(e, root)
    names = F.when(F.col("status") == "active", F.array_join(F.array_sort(F.array_distinct(F.array_append("aliases", F.col("name")))), ","))
    return out.select("id", "status", "mention_count", names.alias("names"))


@query("alias_roots", "SELECT p_partkey AS entity, p_partkey - p_partkey % 10 + CASE WHEN p_partkey < 10 THEN (SELECT min(p_partkey) FROM part) ELSE 0 END AS root FROM part WHERE p_partkey % 10 < 9 OR p_partkey - 1 IN (SELECT p_partkey FROM part)")
def _(t):
    """Chains of parts whose keys share all digits but the last."""
    k = t.raw("part").select(F.col("p_partkey").alias("k"))
    pairs = k.where("k % 10 < 9").join(k.select((F.col("k") - 1).alias("k")), "k", "left_semi").select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))
    return maintain.roots(pairs)


@query("rejected_aliases", "SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_size % 2 = 0")
def _(t):
    x = alias_rows(t)
    return maintain.reject(x, x.where("status = 'confirmed'")).select("a", "b")


@query("summary_edges", "WITH m AS (SELECT atom, entity, date_trunc('week', created_at) AS week FROM mentions JOIN atoms USING (atom)), p AS (SELECT x.week, x.entity AS a, y.entity AS b, x.atom FROM m x JOIN m y ON x.atom = y.atom AND x.entity < y.entity), d AS (SELECT week, a, b FROM p GROUP BY ALL HAVING count(*) >= 2) SELECT week, a, b, atom FROM p JOIN d USING (week, a, b)", "mentions", "atoms")
def _(t):
    out = maintain.summarizes(t.mentions(), t.atoms(), maintain.summaries_due(t.mentions(), t.atoms(), 2, t.pairs()))
    return out.withColumn("week", ntz("week"))


@query("reinforced_atoms", """WITH a AS (SELECT o_orderkey AS atom, o_orderdate AS ts FROM orders), p AS (SELECT l_orderkey AS a, min(l_partkey) AS b FROM lineitem GROUP BY 1)
  SELECT CASE WHEN x.ts < y.ts OR (x.ts = y.ts AND x.atom < y.atom) THEN x.atom ELSE y.atom END AS older, CASE WHEN x.ts < y.ts OR (x.ts = y.ts AND x.atom < y.atom) THEN y.atom ELSE x.atom END AS newer FROM p JOIN a x ON x.atom = p.a JOIN a y ON y.atom = p.b WHERE abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 400::BIGINT * 86400000000""")
def _(t):
    pairs = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.min("l_partkey").alias("b")).withColumn("similarity", F.lit(1.0))
    return maintain.reinforced(pairs, t.atoms(), 400).select("older", "newer")


# ---------------------------------------------------------------- recall, research, portfolio, clinical


@query("prominent_atoms", "SELECT atom, sum(prominence)::DOUBLE AS score, count(DISTINCT entity) AS matches FROM mentions WHERE prominence >= 40 GROUP BY atom", "mentions")
def _(t):
    return graph.mentioning_atoms(t.mentions(), t.entities(), least=40)


@query("episode_atoms", "SELECT o_custkey AS episode, o_orderkey AS atom, o_orderdate AS created_at FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    links = t.atoms().select(F.col("cwd").alias("episode"), "atom")
    return graph.atoms_of_episodes(t.atoms(), links, t.raw("customer").select(F.col("c_custkey").alias("episode")))


@query("recall_by_activation", """WITH f AS (SELECT atom, created_at FROM atoms ORDER BY created_at, atom LIMIT 150), g AS (SELECT atom, sum(prominence * (entity % 5))::DOUBLE AS score FROM mentions WHERE entity % 5 > 0 GROUP BY 1)
  SELECT atom, coalesce(score, 0) AS score FROM f LEFT JOIN g USING (atom) ORDER BY score DESC, created_at, atom LIMIT 50""", "atoms", "mentions")
def _(t):
    act = t.entities().where("entity % 5 > 0").select("entity", (F.col("entity") % 5).cast("double").alias("activation"))
    return recall.recall_episode(t.atoms(), activation=act, mentions=t.mentions()).select("atom", "score")


def packet(t: Tables) -> dict[str, DataFrame]:
    a = t.activities()
    q = a.select(F.col("kind").alias("query")).distinct().withColumn("text", F.col("query"))
    idx = search.Index.build(q.select(F.lit("kind").alias("label"), F.col("query").alias("id"), "text"))
    from mnemo.plans.catalogue import typed_edges

    return recall.context_packet(q, idx, touches(t), a.select(F.col("source_id").alias("activity"), "ts", "snippet"), typed_edges(t))


@query("context_packet_anchors", "SELECT DISTINCT event_type AS query, 'kind' AS label, event_type AS id FROM events")
def _(t):
    return packet(t)["anchors"].select("query", "label", "id")


@query("meetings", "SELECT source_id FROM activities WHERE kind = 'click' AND ts >= TIMESTAMP '2024-01-17'", "activities")
def _(t):
    return recall.meetings(t.activities(), "2024-01-17 00:00:00", None, ["click"], "events").select("source_id")


@query("meetings_fallback", "SELECT source_id FROM activities WHERE ts >= TIMESTAMP '2024-01-17'", "activities")
def _(t):
    return recall.meetings(t.activities(), "2024-01-17 00:00:00", None, ["calendar_event"], "events").select("source_id")


@query("decision_log", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, source_id) AS r FROM activities WHERE kind IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-01'), y AS (SELECT *, sum(length(snippet)) OVER (PARTITION BY kind ORDER BY r) AS used FROM x WHERE r <= 20) SELECT source_id, kind, ts FROM y WHERE used <= 100", "activities")
def _(t):
    return recall.log_of_kinds(t.activities(), ["click", "error"], "2024-01-01 00:00:00", None, ["kind"], 20, 100).select("source_id", "kind", "ts")


@query("impact_hits", "SELECT p_brand AS process, sum(l_quantity::BIGINT)::BIGINT AS hits FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(t):
    x = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("process"), F.col("l_quantity").cast("long").alias("hits"))
    return recall.hits_by(x, "process")


@query("children_for_queries", "WITH s AS (SELECT s_name AS instance, s_nationkey AS n FROM supplier), q AS (SELECT DISTINCT n_nationkey AS n FROM nation) SELECT q.n AS query, instance FROM q JOIN s USING (n) UNION ALL SELECT q.n, instance FROM (SELECT * FROM q ANTI JOIN s USING (n)) q, s")
def _(t):
    q = t.raw("nation").select(F.col("n_nationkey").alias("query"), F.col("n_nationkey").cast("string").alias("text"))
    return recall.children_for(q, instances(t))


@query("answers_by_type", "SELECT o_orderkey AS query, CASE WHEN o_orderstatus = 'F' THEN 'status' ELSE 'echo' END AS type, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE o_orderpriority END AS answer FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(t):
    r = t.raw("orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("text"))
    out = recall.answer(r, {"F": lambda x: x.select("query", F.lit("ok").alias("answer")), "O": lambda x: x.select("query", F.col("text").alias("answer"))})
    return out.select("query", F.when(F.col("type") == "F", "status").otherwise("echo").alias("type"), "answer")


@query("across_instances", "SELECT n_nationkey AS id, 'nations' AS instance FROM nation UNION ALL SELECT r_regionkey, 'regions' FROM region")
def _(t):
    tables = {"nations": t.raw("nation").select(F.col("n_nationkey").alias("id")), "regions": t.raw("region").select(F.col("r_regionkey").alias("id")), "broken": t.raw("part")}
    return recall.across_instances(lambda x: x.select("id"), tables)


@query("collected_sources", "SELECT o_orderkey AS id FROM orders UNION ALL SELECT event_id FROM events")
def _(t):
    out, errors = recall.collected({"a": lambda: t.raw("orders").select(F.col("o_orderkey").alias("id")), "b": lambda: t.raw("events").select(F.col("event_id").alias("id")), "c": lambda: t.raw("missing")})
    assert list(errors) == ["c"]
    return out


@query("event_search", """WITH h AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity >= 45), e AS (SELECT DISTINCT event FROM research WHERE domain = 'ASIA') SELECT id FROM h WHERE id IN (SELECT event FROM e)""", "research")
def _(t):
    hits = t.raw("lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("id")).distinct()
    return research.events_by_text(hits, t.research(), "ASIA")


@query("batches_of_20", "SELECT o_custkey % 16 AS chunk, (o_custkey % 16) || '-' || ((row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1) // 20) AS batch, o_orderkey FROM orders")
def _(t):
    o = t.raw("orders").select((F.col("o_custkey") % 16).alias("chunk"), "o_orderkey")
    return research.in_batches(o, "o_orderkey", 20, "chunk").select("chunk", "batch", "o_orderkey")


def batches(t: Tables) -> dict[str, DataFrame]:
    """An extraction result for each customer: itself, its nation, an event and a trend."""
    c = t.raw("customer")
    who = lambda n, k: F.struct(n.alias("name"), F.lit(k).alias("type"))
    nation = F.concat(F.lit("Nation "), F.col("c_nationkey"))
    v = F.struct(F.concat(F.lit("Deal of "), "c_name").alias("title"), F.array(F.struct(F.col("c_name").alias("name"), F.lit("buyer").alias("role"))).alias("involved_entities"))
    r = F.struct(F.col("c_name").alias("from_entity"), nation.alias("to_entity"), F.lit("lives_in").alias("relation_type"))
    tr = F.struct(F.col("c_mktsegment").alias("name"), F.array(F.concat(F.lit("deal of "), "c_name")).alias("linked_events"))
    return research.extraction_tables(c.select(F.col("c_custkey").alias("batch"), F.array("c_custkey").alias("activity_ids"), F.array(who(F.col("c_name"), "person"), who(nation, "place")).alias("entities"), F.array(v).alias("events"), F.array(r).alias("relationships"), F.array(tr).alias("trends")))


SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[\\s_]+', '-', 'g'), '[^a-z0-9\\-]', '', 'g'), '-{{2,}}', '-', 'g'), '-')"


@query("extraction_edges", f"""WITH c AS (SELECT c_custkey, {SLUG.format("c_name")} AS who, 'nation-' || c_nationkey AS nation, {SLUG.format("'Deal of ' || c_name")} AS deal, {SLUG.format("c_mktsegment")} AS trend FROM customer)
  SELECT 'involved' AS kind, who AS src, deal AS dst FROM c UNION SELECT 'related', who, nation FROM c UNION SELECT 'trend', deal, trend FROM c UNION SELECT 'mentions', c_custkey::VARCHAR, who FROM c UNION SELECT 'mentions', c_custkey::VARCHAR, nation FROM c""")
def _(t):
    x = batches(t)
    one = lambda k, n, a, b: x[n].select(F.lit(k).alias("kind"), F.col(a).cast("string").alias("src"), F.col(b).alias("dst"))
    return one("involved", "involved_in", "entity_key", "event_key").union(one("related", "related", "a", "b")).union(one("trend", "part_of_trend", "event_key", "trend_key")).union(one("mentions", "entity_mentions", "activity", "entity_key")).distinct()


@query("domain_profile", """WITH w AS (SELECT * FROM research WHERE date >= TIMESTAMP '2000-06-01'), k AS (SELECT domain, trend, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, trend) AS i FROM k)
  SELECT w.domain, count(*) AS mentions, count(DISTINCT entity) AS entities, count(DISTINCT event) AS events, (SELECT string_agg(trend, ',' ORDER BY i) FROM r WHERE r.domain = w.domain AND i <= 5) AS topics FROM w GROUP BY w.domain""", "research")
def _(t):
    return research.domain_profile(t.research(), at("2000-06-01"), 5)


@query("local_references", "SELECT DISTINCT s_suppkey AS project, s_nationkey AS target FROM supplier WHERE s_nationkey IN (SELECT s_suppkey FROM supplier) AND s_nationkey <> s_suppkey")
def _(t):
    s = t.raw("supplier")
    manifests = s.select(F.col("s_suppkey").alias("project"), F.concat(F.lit("file:/w/"), "s_nationkey", F.lit("/lib")).alias("version")).union(s.select("s_suppkey", F.lit("^1.0")))
    return portfolio.local_references(manifests, s.select(F.col("s_suppkey").alias("project"), F.concat(F.lit("/w/"), "s_suppkey").alias("path")))


@query("session_projects", "SELECT o_orderkey AS session, max(s_suppkey) AS project FROM orders JOIN supplier ON s_suppkey = o_custkey % 500 GROUP BY 1")
def _(t):
    ses = t.raw("orders").select(F.col("o_orderkey").alias("session"), F.concat(F.lit("/w/"), F.col("o_custkey") % 500, F.lit("/src/x")).alias("dir"))
    p = t.raw("supplier").select(F.col("s_suppkey").alias("project"), F.concat(F.lit("/w/"), "s_suppkey", F.lit("/")).alias("path"))
    return portfolio.match_project(ses, p)


@query("relations", "SELECT DISTINCT src AS a, dst AS b, 'depends' AS kind, CASE WHEN src < dst THEN 'high' ELSE 'low' END AS confidence FROM depends_on", "depends_on")
def _(t):
    e = t.depends_on().select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("depends").alias("kind"))
    return portfolio.relations(e.where("a < b").withColumn("confidence", F.lit("high")), e.withColumn("confidence", F.lit("low")))


@query("nearest_observations", """WITH v AS (SELECT *, date - DATE '2024-01-10' AS d1, date - DATE '2024-01-20' AS d2 FROM labs WHERE value IS NOT NULL), g AS (SELECT patient, code, arg_min(struct_pack(date, value), struct_pack(k := abs(d1), date, id)) AS x, arg_min(struct_pack(date, value), struct_pack(k := abs(d2), date, id)) AS y FROM v GROUP BY ALL)
  SELECT patient, code, x.value AS first, y.value AS last, y.date - x.date AS days FROM g""", *CLIN)
def _(t):
    return clinical.compare(t.labs(), at("2024-01-10", "date"), at("2024-01-20", "date")).select("patient", "code", "first", "last", "days")


@query("equal_width_bounds", "WITH v AS (SELECT arg_max(value, struct_pack(date, id)) AS value FROM labs JOIN patients USING (patient) GROUP BY patient, code), r AS (SELECT min(value) AS a, max(value) AS b FROM v) SELECT i, round(a + (b - a) * i / 5, 6) AS bound FROM r, (SELECT unnest([1, 2, 3, 4]) AS i)", *CLIN)
def _(t):
    bounds = clinical.equal_width(t.labs(), t.patients())
    return t.spark.createDataFrame([(i, round(b, 6)) for i, b in enumerate(bounds, 1)], "i int, bound double")


@query("procedures", "SELECT patient, code, date FROM labs WHERE patient IN (SELECT patient FROM patients WHERE gender = 'F')", *CLIN)
def _(t):
    return clinical.procedures(t.labs(), t.patients().where("gender = 'F'")).select("patient", "code", "date")


def ranked(t: Tables, label: str, df: DataFrame, text: str, key: str) -> DataFrame:
    """The three best rows of one table for each of its distinct texts."""
    docs = df.select(F.lit(label).alias("label"), F.col(key).alias("id"), F.col(text).alias("text"))
    return search.Index.build(docs).search(docs.select(F.col("text").alias("query"), "text").distinct(), 3).select("query", "id", "score")


BEST = """WITH d AS ({docs}), tok AS (SELECT id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM d), len AS (SELECT id, len(w) AS n FROM tok), st AS (SELECT count(*) AS docs, sum(n) AS total FROM len), q AS (SELECT DISTINCT text AS query, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM d),
  post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
  part AS (SELECT query, id, round(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n * docs / total)), 9)::DECIMAL(20, 9) AS p FROM post JOIN q USING (term) JOIN df USING (term) JOIN len USING (id), st),
  sc AS (SELECT query, id, round(sum(p)::DOUBLE, 6) AS score FROM part GROUP BY ALL) SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 3 AND score > 0"""


@query("search_patients", BEST.format(docs="SELECT c_custkey AS id, c_mktsegment || ' ' || c_nationkey AS text FROM customer"))
def _(t):
    return ranked(t, "Patient", t.raw("customer").withColumn("text_", F.concat_ws(" ", "c_mktsegment", "c_nationkey")), "text_", "c_custkey")


@query("search_concepts", BEST.format(docs="SELECT p_partkey AS id, p_type AS text FROM part"))
def _(t):
    return ranked(t, "Concept", t.raw("part"), "p_type", "p_partkey")


@query("search_projects", BEST.format(docs="SELECT s_suppkey AS id, s_name AS text FROM supplier"))
def _(t):
    return ranked(t, "Project", t.raw("supplier"), "s_name", "s_suppkey")
