"""Trend detection over mentions (entity, domain, event, role, trend, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions.text import slugify
from mnemo.operators import graph
from mnemo.operators.frames import top


def trending(mentions: DataFrame, what: list[str], current: Column, compare: Column) -> DataFrame:
    """Counts in [current, ..) and [compare, current) in one pass; only what occurs in the first."""
    now, then = F.col("date") >= current, (F.col("date") >= compare) & (F.col("date") < current)
    return mentions.where(F.col("date") >= compare).groupBy(*what).agg(F.count_if(now).alias("current"), F.count_if(then).alias("previous")).where("current > 0").withColumn("change", F.col("current") - F.col("previous"))


def landscape(mentions: DataFrame, entities: DataFrame, start: Column, n: int = 20) -> DataFrame:
    """A tagged union a domain: entities by mentions in the window (none counts 0), events, trends by last date."""
    win = mentions.where(F.col("date") >= start)
    e = entities.join(win.groupBy("domain", "entity").agg(F.count("*").alias("value")), ["domain", "entity"], "left").select("domain", F.lit("entity").alias("what"), F.col("entity").alias("name"), F.coalesce("value", F.lit(0)).alias("value"))
    v = win.groupBy("domain", F.col("event").cast("string").alias("name")).agg(F.count_distinct("entity").alias("value")).select("domain", F.lit("event").alias("what"), "name", "value")
    t = mentions.groupBy("domain", F.col("trend").alias("name")).agg(F.unix_date(F.to_date(F.max("date"))).cast("long").alias("value")).select("domain", F.lit("trend").alias("what"), "name", "value")
    return top(e.union(v).union(t), ["domain", "what"], [F.desc("value"), "name"], n, "rank")


def entity_timeline(mentions: DataFrame, entities: DataFrame | None = None, n: int = 30) -> DataFrame:
    m = mentions if entities is None else mentions.join(entities, "entity", "left_semi")
    return top(m.select("entity", "event", "role", "date").distinct(), ["entity"], [F.desc("date"), "event", "role"], n, "rank")


def events_by_text(hits: DataFrame, mentions: DataFrame, domain: str | None = None) -> DataFrame:
    """Search hits (query, id, score) of events, kept where they involve an entity of the domain."""
    m = mentions if domain is None else mentions.where(F.col("domain") == domain)
    return hits.join(m.select(F.col("event").alias("id")), "id", "left_semi")


def domain_profile(mentions: DataFrame, since: Column, n: int = 5) -> DataFrame:
    """(domain, mentions, entities, events, topics) since a time; topics are the n most mentioned trends."""
    x = mentions.where(F.col("date") >= since)
    best = top(x.groupBy("domain", "trend").agg(F.count("*").alias("n")), ["domain"], [F.desc("n"), "trend"], n, "rank")
    names = best.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "trend"))), lambda t: t["trend"]), ",").alias("topics"))
    return x.groupBy("domain").agg(F.count("*").alias("mentions"), F.count_distinct("entity").alias("entities"), F.count_distinct("event").alias("events")).join(names, "domain")


network = graph.network


def extraction_tables(batches: DataFrame) -> dict[str, DataFrame]:
    """Nested extraction results (batch, activity_ids, entities, events, relationships, trends) to tables:
    keyed nodes, roles, relations and the links of each batch's activities to all its entities and events."""
    key = lambda c: slugify(c)
    ent = batches.select("batch", F.explode("entities").alias("e")).select("batch", key(F.col("e.name")).alias("entity_key"), "e.*")
    ev = batches.select("batch", F.explode("events").alias("v")).select("batch", key(F.col("v.title")).alias("event_key"), "v.*")
    roles = ev.select("event_key", F.explode("involved_entities").alias("i")).select("event_key", key(F.col("i.name")).alias("entity_key"), F.col("i.role").alias("role"))
    known = ent.select("entity_key").distinct()
    rel = batches.select(F.explode("relationships").alias("r")).select(key(F.col("r.from_entity")).alias("a"), key(F.col("r.to_entity")).alias("b"), F.col("r.relation_type").alias("kind"))
    tr = batches.select(F.explode("trends").alias("t")).select(key(F.col("t.name")).alias("trend_key"), F.col("t.name").alias("name"), F.explode_outer("t.linked_events").alias("linked")).select("trend_key", "name", key(F.col("linked")).alias("event_key"))
    acts = batches.select("batch", F.explode("activity_ids").alias("activity"))
    return {
        "entities": ent.drop("batch").dropDuplicates(["entity_key"]),
        "events": ev.drop("batch", "involved_entities").dropDuplicates(["event_key"]),
        "involved_in": roles.join(known, "entity_key", "left_semi").distinct(),
        "related": rel.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi").distinct(),
        "trends": tr.select("trend_key", "name").distinct(),
        "part_of_trend": tr.where("event_key is not null").join(ev.select("event_key"), "event_key", "left_semi").select("event_key", "trend_key").distinct(),
        "entity_mentions": acts.join(ent.select("batch", "entity_key"), "batch").select("activity", "entity_key").distinct(),
        "event_mentions": acts.join(ev.select("batch", "event_key"), "batch").select("activity", "event_key").distinct(),
    }


def in_batches(df: DataFrame, key: str, size: int = 20, chunk: str | None = None) -> DataFrame:
    """Rows with a batch number, `size` to a batch in order of key, within chunks so that no task counts all."""
    from pyspark.sql import Window

    c = F.col(chunk) if chunk else F.pmod(F.xxhash64(key), F.lit(64))
    x = df.withColumn("_c", c)
    n = F.row_number().over(Window.partitionBy("_c").orderBy(key))
    return x.withColumn("batch", F.concat_ws("-", F.col("_c"), F.floor((n - 1) / size))).drop("_c")
