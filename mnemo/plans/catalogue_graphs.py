"""Queries over whole ingested batches, context packets, changes by repository, relations and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.operators import portfolio, recall
from mnemo.operators.communities import communities
from mnemo.plans.catalogue import EDGES_SQL, TOUCH_SQL, query
from mnemo.plans.catalogue_more import flat, ntz, packet
from mnemo.plans.roles import Tables
from mnemo.sources import normalize

# ---------------------------------------------------------------- the twelve tables of a batch


def batch(t: Tables) -> dict[str, DataFrame]:
    """Orders as chat records of two channels that answer the order with the last digit cut off. A message is
    written as many microseconds after its order's date as the key says, seconds before the point and six digits after it."""
    key, million = F.col("o_orderkey").cast("string"), F.lit(1_000_000)
    second = (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.floor(F.col("o_orderkey") / million)).cast("string")
    o = t.raw("orders")
    first = o.select((F.col("o_orderkey") * 10).alias("k"), F.col("o_orderdate").alias("first"))
    text = F.concat(F.lit("#Team"), F.col("o_custkey") % 5, F.lit(" <@U"), F.col("o_custkey") % 7, F.lit("> "), key)
    c = o.select(F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("user"), text.alias("text"), F.concat(second, F.lit("."), F.lpad((F.col("o_orderkey") % million).cast("string"), 6, "0")).alias("ts"), F.lit("message").alias("type"), F.lit(None).cast("string").alias("thread_ts"), F.lit(None).cast("string").alias("subtype"), F.lit(None).cast("string").alias("bot_id"), (F.col("o_orderkey") % 2).alias("channel"))
    one = normalize.chat(c.where("channel = 0"), "even").unionByName(normalize.chat(c.where("channel = 1"), "odd"))
    return normalize.graph_tables(one)


BATCH = """WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS ch, 'u' || (o_custkey % 50) AS u, epoch(o_orderdate)::BIGINT || '.' || lpad(o_orderkey::VARCHAR, 6, '0') AS stamp, o_orderdate + to_microseconds(o_orderkey) AS ts, 'team' || (o_custkey % 5) AS tag, 'U' || (o_custkey % 7) AS who, '#Team' || (o_custkey % 5) || ' <@U' || (o_custkey % 7) || '> ' || o_orderkey AS text FROM orders),
  a AS (SELECT *, ch || ':' || stamp AS sid FROM r)"""

#: The same with stamps of keys of any length: whole seconds go before the point.
STAMPED = BATCH.replace("epoch(o_orderdate)::BIGINT || '.' || lpad(o_orderkey::VARCHAR, 6, '0')", "(epoch(o_orderdate)::BIGINT + o_orderkey // 1000000) || '.' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0')")


@query("batch_activities", f"{STAMPED} SELECT sid AS source_id, ts, 'message' AS kind, text AS snippet FROM a")
def _(t):
    return batch(t)["activities"].select("source_id", ntz("timestamp").alias("ts"), "kind", "snippet")


@query("batch_persons", f"{BATCH} SELECT DISTINCT 'slack:' || u AS person_key, u AS source_id FROM a")
def _(t):
    return batch(t)["persons"].select("person_key", "source_id")


@query("batch_topics", f"{BATCH} SELECT DISTINCT tag AS name, 'semantic' AS tier FROM a")
def _(t):
    return batch(t)["topics"].select("name", "tier")


@query("batch_containers", f"{BATCH} SELECT DISTINCT 'slack' AS source, ch AS container_id FROM a")
def _(t):
    return batch(t)["containers"].select("source", "container_id")


@query("batch_accounts", f"{BATCH} SELECT DISTINCT 'slack' AS source, u AS account_id, 'slack:' || u AS linked_person_key FROM a")
def _(t):
    return batch(t)["accounts"].select("source", "account_id", "linked_person_key")


@query("batch_from_person", f"{STAMPED} SELECT sid AS source_id, 'slack:' || u AS person_key FROM a")
def _(t):
    return batch(t)["from_person"].select("sid.source_id", "person_key")


@query("batch_in_container", f"{STAMPED} SELECT sid AS source_id, ch AS container_id FROM a")
def _(t):
    return batch(t)["in_container"].select("sid.source_id", "container_id")


@query("batch_mentions", f"{STAMPED} SELECT sid AS source_id, tag AS name FROM a")
def _(t):
    return batch(t)["mentions"].select("sid.source_id", "name")


@query("batch_mentions_person", f"{STAMPED} SELECT sid AS source_id, who AS mention FROM a")
def _(t):
    return batch(t)["mentions_person"].select("sid.source_id", "mention")


@query("batch_replies_to", """SELECT 'repo!c' || l_orderkey || '-' || l_linenumber AS source_id, 'repo#' || l_orderkey AS parent FROM lineitem GROUP BY ALL""")
def _(t):
    x = t.raw("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("b").alias("body"), F.concat(F.lit("https://h/pulls/"), "l_orderkey").alias("pull_request_url"), F.lit("u").alias("html_url"), F.col("l_shipdate").alias("created_at"), F.struct(F.lit("s").alias("login"), F.lit("a").alias("avatar_url")).alias("user"))
    return normalize.graph_tables(normalize.pull_comment(x, "repo"))["replies_to"].select("sid.source_id", F.col("parent.source_id").alias("parent"))


@query("batch_owns", f"{STAMPED} SELECT u AS account_id, sid AS source_id FROM a")
def _(t):
    return batch(t)["owns"].select("account_id", "sid.source_id")


@query("batch_identifies", f"{STAMPED} SELECT 'slack:' || u AS person_key, u AS account_id, min(ts) AS first_seen FROM a GROUP BY ALL")
def _(t):
    return batch(t)["identifies"].select("person_key", "account_id", ntz("first_seen").alias("first_seen"))


# ---------------------------------------------------------------- context packets


@query(
    "context_packet_facts",
    f"""WITH {TOUCH_SQL}, c AS (SELECT node AS seed, count(DISTINCT activity) AS activities FROM touches WHERE label = 'kind' GROUP BY 1),
    p AS (SELECT x.node AS seed, y.label, y.node AS other, count(*) AS paths FROM touches x JOIN touches y USING (activity) WHERE x.label = 'kind' AND NOT (x.node = y.node AND x.label = y.label) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY paths DESC, other) AS k FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY paths DESC, label, other) AS k2 FROM r WHERE k <= 3),
    n AS (SELECT seed, string_agg(other, ', ' ORDER BY paths DESC, other) AS names FROM q WHERE k2 <= 3 GROUP BY 1)
    SELECT seed AS query, seed, seed || ': ' || activities || ' activities; related: ' || names AS fact FROM c JOIN n USING (seed)""",
    "activities",
)
def _(t):
    return packet(t)["facts"].select("query", "seed", "fact")


@query("context_packet_slice", f"WITH {EDGES_SQL}, x AS (SELECT DISTINCT dst AS root, kind, src AS neighbour FROM edges WHERE dst LIKE 'kind:%') SELECT root, kind, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY kind, neighbour) AS r FROM x) WHERE r <= 40", "activities")
def _(t):
    """The slice of packets whose anchors are named as the edges name kinds."""
    from mnemo.operators import search
    from mnemo.plans.catalogue import touches, typed_edges

    a = t.activities()
    kinds = a.select(F.col("kind").alias("query")).distinct()
    idx = search.Index.build(kinds.select(F.lit("kind").alias("label"), F.concat(F.lit("kind:"), "query").alias("id"), F.col("query").alias("text")))
    out = recall.context_packet(kinds.withColumn("text", F.col("query")), idx, touches(t), a.select(F.col("source_id").alias("activity"), "ts", "snippet"), typed_edges(t))
    return out["slice"].select("root", "kind", "neighbour")


# ---------------------------------------------------------------- changes by repository


@query(
    "change_context",
    """WITH x AS (SELECT o_custkey % 20 AS repo, o_orderkey::VARCHAR AS source_id, o_orderdate AS ts, CASE WHEN length(o_orderpriority || ' ' || o_orderstatus) > 8 THEN substr(o_orderpriority || ' ' || o_orderstatus, 1, 8) || '…' ELSE o_orderpriority || ' ' || o_orderstatus END AS snippet FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-01-01'),
    y AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, source_id) AS r FROM x), z AS (SELECT *, sum(length(snippet)) OVER (PARTITION BY repo ORDER BY r) AS used FROM y WHERE r <= 20),
    i AS (SELECT l_orderkey::VARCHAR AS source_id, p_brand AS process, sum(l_quantity::BIGINT)::BIGINT AS hits FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY hits DESC, process) AS n FROM i)
    SELECT repo, z.source_id, ts, snippet, process, hits FROM z LEFT JOIN k ON k.source_id = z.source_id AND n <= 3 WHERE used <= 150""",
)
def _(t):
    """Pull requests by repository with cut snippets and the processes they touch most."""
    a = t.raw("orders").select((F.col("o_custkey") % 20).alias("container"), F.col("o_orderkey").cast("string").alias("source_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("kind"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("snippet"))
    p = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("process"))
    impacts = t.raw("lineitem").join(p, "l_partkey").select(F.col("l_orderkey").cast("string").alias("change"), "process", F.col("l_quantity").cast("long").alias("hits"))
    return recall.change_summary(a, "container", "1996-01-01 00:00:00", "1998-01-01 00:00:00", ["O", "F"], impacts, 8, 20, 150, 3)


# ---------------------------------------------------------------- relations of several detectors


@query(
    "project_relations",
    """WITH o AS (SELECT DISTINCT project, dep FROM uses), n AS (SELECT dep, count(*) AS users FROM o GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20),
    shared AS (SELECT x.project AS a, y.project AS b, 'shared_package' AS kind, CASE WHEN max(users) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM o x JOIN o y ON x.dep = y.dep AND x.project < y.project JOIN n ON n.dep = x.dep GROUP BY ALL),
    g AS (SELECT s_nationkey, min(s_suppkey) AS head FROM supplier GROUP BY 1), org AS (SELECT head AS a, s_suppkey AS b, 'same_org' AS kind, 'medium' AS confidence FROM supplier JOIN g USING (s_nationkey) WHERE s_suppkey <> head),
    loc AS (SELECT DISTINCT s_suppkey AS a, s_nationkey AS b, 'local_package' AS kind, 'high' AS confidence FROM supplier WHERE s_nationkey IN (SELECT s_suppkey FROM supplier) AND s_nationkey <> s_suppkey)
    SELECT * FROM loc UNION ALL SELECT * FROM shared UNION ALL SELECT * FROM org""",
    "uses",
)
def _(t):
    s = t.raw("supplier")
    home = s.select(F.col("s_suppkey").alias("project"), F.concat(F.lit("/w/"), "s_suppkey").alias("path"))
    local = portfolio.local_references(s.select(F.col("s_suppkey").alias("project"), F.concat(F.lit("../"), "s_nationkey").alias("version")), home)
    org = portfolio.same_org(s.select(F.col("s_suppkey").alias("project"), F.concat(F.lit("git@host:N"), "s_nationkey", F.lit("/r"), "s_suppkey", F.lit(".git")).alias("remote")))
    return portfolio.relations(
        local.select(F.col("project").alias("a"), F.col("target").alias("b"), F.lit("local_package").alias("kind"), F.lit("high").alias("confidence")),
        portfolio.package_groups(t.uses(), block=20)["pairs"].select("a", "b", F.lit("shared_package").alias("kind"), "confidence"),
        org.select("a", "b", F.lit("same_org").alias("kind"), F.lit("medium").alias("confidence")),
    )


# ---------------------------------------------------------------- sessions and documents as records


def sessions_of(t: Tables) -> DataFrame:
    """Conversations as sessions: texts of users and assistants in order."""
    c = t.raw("conversations")
    texts = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]).alias(f"{role}_texts")
    at = F.timestamp_seconds(F.col("conv_id") + 1_700_000_000)
    g = c.groupBy("conv_id").agg(texts("user"), texts("assistant"), F.max("turn").alias("turns"))
    return g.where(F.size("user_texts") > 0).select(F.concat(F.lit("s"), "conv_id").alias("session"), F.concat(F.lit("/w/p"), F.col("conv_id") % 5).alias("cwd"), F.lit(None).cast("string").alias("slug"), F.concat(F.lit("Main-"), F.col("conv_id") % 3).alias("branch"), at.alias("last"), "user_texts", "assistant_texts")


SESSIONS = """WITH g AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS u, coalesce(list(text ORDER BY turn) FILTER (role = 'assistant'), []) AS a FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0)"""


@query(
    "session_records",
    SESSIONS + """, x AS (SELECT *, 'Session in /w/p' || (conv_id % 5) || ' (' || len(u) || ' requests)' || chr(10) || 'First request: ' || substr(u[1], 1, 500) || CASE WHEN len(u) > 1 THEN chr(10) || 'Last request: ' || right(u[-1], 300) ELSE '' END AS s FROM g)
    SELECT 's' || conv_id AS source_id, make_timestamp((1700000000 + conv_id) * 1000000) AS ts, 'session' AS kind, CASE WHEN length(s) > 2000 THEN substr(s, 1, 2000) || '…' ELSE s END AS snippet, '/w/p' || (conv_id % 5) AS container, len(u) + len(a) AS messages FROM x""",
)
def _(t):
    r = normalize.session(sessions_of(t))
    return r.select(F.col("activity.source_id").alias("source_id"), ntz("activity.timestamp").alias("ts"), F.col("activity.kind").alias("kind"), F.col("activity.snippet").alias("snippet"), F.col("container.name").alias("container"), F.col("activity.message_count").alias("messages"))


@query("session_transcripts", SESSIONS + " SELECT 's' || conv_id AS session, substr(array_to_string(list_transform(range(1, greatest(len(u), len(a)) + 1), lambda i: CASE WHEN u[i] IS NULL THEN '' ELSE 'User: ' || u[i] END || CASE WHEN u[i] IS NOT NULL AND a[i] IS NOT NULL THEN chr(10) ELSE '' END || CASE WHEN a[i] IS NULL THEN '' ELSE 'Assistant: ' || a[i] END), chr(10)), 1, 12000) AS transcript FROM g")
def _(t):
    return sessions_of(t).select("session", normalize.transcript().alias("transcript"))


@query("doc_records", """SELECT 'doc:' || page_id AS source_id, make_timestamp((1700000000 + page_id) * 1000000) AS ts, 'doc' AS kind, url || chr(10) || '#Page' || (page_id % 9) AS snippet, 'page' || (page_id % 9) || '/semantic' AS topics, 'clickup:w' || (page_id % 4) AS person_key FROM pages""")
def _(t):
    n = F.col("page_id")
    x = t.raw("pages").select(n.cast("string").alias("id"), F.col("url").alias("name"), F.concat(F.lit("#Page"), n % 9).alias("content"), F.concat(F.lit("w"), n % 4).alias("creator"), ((n + 1_700_000_000) * 1000).cast("string").alias("date_updated"))
    return flat(normalize.doc(x, "space")).select("source_id", "ts", "kind", "snippet", "topics", "person_key")


# ---------------------------------------------------------------- communities


@query("theme_communities")
def _(t):
    """Themes of entities by modularity over associations of weight 2 and more."""
    return communities(t.assoc(), 2, once=True)
