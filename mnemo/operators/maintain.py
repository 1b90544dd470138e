"""Maintenance: counts, cursors, retention, alias collapse, tiers, pass runner, optional passes."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators.frames import dealt, saved, top
from mnemo.operators.search import nearest
from mnemo.operators.vectors import VectorIndex, near_copies  # noqa: F401  near_copies is the pass over all atoms


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.union(one)
    return out


def cursors(seen: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The latest time of each source and container; never moves back."""
    both = seen if old is None else seen.union(old.select("source", "container", F.col("latest").alias("ts")))
    return both.groupBy("source", "container").agg(F.max("ts").alias("latest"))


def newer(df: DataFrame, cursor: DataFrame, as_of: Column, backfill_days: int = 7) -> DataFrame:
    """Rows after their container's cursor; a container without one starts backfill_days before as_of."""
    since = F.coalesce("latest", as_of - F.expr(f"INTERVAL {int(backfill_days)} DAYS"))
    return df.join(cursor, ["source", "container"], "left").where(F.col("ts") > since).drop("latest")


def retained(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return events.where(F.col("event_date") >= F.date_sub(as_of, days))


def alias_candidates(aliases: DataFrame, entities: DataFrame, as_of: Column, minutes: int = 5, n: int = 20) -> DataFrame:
    """Suspected pairs of mentioned entities that have settled, most confident first."""
    e = entities.where("mention_count >= 1").select("id")
    x = aliases.where("status = 'suspected'").where(F.col("created_at") <= as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return x.join(e.toDF("a"), "a", "left_semi").join(e.toDF("b"), "b", "left_semi").orderBy(F.desc("confidence"), "a", "b").limit(n)


def evidence(mentions: DataFrame, atoms: DataFrame, entities: DataFrame, n: int = 3, chars: int = 200) -> DataFrame:
    """The newest n atoms of each entity, cut to some characters."""
    x = mentions.join(entities.select("entity"), "entity", "left_semi").join(atoms, "atom")
    return top(x, ["entity"], [F.desc("created_at"), "atom"], n, "rank").withColumn("content", F.substring("content", 1, chars))


def roots(confirmed: DataFrame) -> DataFrame:
    """(entity, root) of confirmed alias pairs (a, b): chains of any length resolve to their least member.

    Each round hooks every entity to the least root of its neighbours and then follows that root's own
    root, until nothing moves. State stays in tables, which cut lineage; only a count comes to the driver."""
    both = saved(confirmed.select(F.col("a").alias("entity"), F.col("b").alias("other")).union(confirmed.select("b", "a")).distinct(), "alias-edges")
    label = both.groupBy("entity").agg(F.least(F.min("other"), F.first("entity")).alias("root"))
    while True:
        label = saved(label, "alias")
        near = both.join(label.toDF("other", "near"), "other").groupBy("entity").agg(F.min("near").alias("near"))
        hooked = label.join(near, "entity").select("entity", "root", F.least("root", "near").alias("low"))
        step = saved(hooked.join(label.toDF("low", "top"), "low", "left").select("entity", "root", F.least("low", "top").alias("next")), "alias")
        label = step.select("entity", F.col("next").alias("root"))
        if not step.where("next <> root").limit(1).count():
            return label


def same_name_roots(entities: DataFrame) -> DataFrame:
    """(entity, root): entities of equal name and type have the least as their root."""
    head = entities.groupBy("name", "type").agg(F.min("entity").alias("root"))
    return entities.join(head, ["name", "type"]).select("entity", "root")


def collapse_mentions(mentions: DataFrame, root: DataFrame) -> DataFrame:
    """Mentions rewired to roots, once an atom and entity, with the greatest prominence."""
    x = mentions.join(root, "entity", "left").withColumn("entity", F.coalesce("root", "entity"))
    return x.groupBy("atom", "entity").agg(F.max("prominence").alias("prominence"))


def collapse_entities(entities: DataFrame, root: DataFrame) -> DataFrame:
    """Entities with counts, names and last times of what merged into them; the merged are marked."""
    x = entities.join(root.withColumnRenamed("entity", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    agg = x.groupBy("root").agg(F.sum("mention_count").alias("mention_count"), F.max("last_seen").alias("last_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")))))).alias("names"))
    head = x.where("id = root").drop("mention_count", "last_seen", "aliases").join(agg, "root").withColumn("aliases", F.array_remove("names", F.col("name")))
    gone = x.where("id <> root").withColumn("status", F.lit("merged"))
    return head.drop("names", "root").unionByName(gone.drop("root"), allowMissingColumns=True)


def reject(aliases: DataFrame, rejected: DataFrame) -> DataFrame:
    return aliases.join(rejected.select("a", "b"), ["a", "b"], "left_anti")


def tier_changes(atoms: DataFrame, new_tier: Column) -> DataFrame:
    """(tier, before, after, delta)."""
    b = atoms.groupBy("tier").agg(F.count("*").alias("before"))
    a = atoms.select(new_tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("after"))
    return b.join(a, "tier", "full").fillna(0).withColumn("delta", F.col("after") - F.col("before"))


def _watch(spark: SparkSession, group: str, timeout: float, done: threading.Event, late: threading.Event) -> None:
    """Cancels a group's jobs from a time on, those too that only start later."""
    if not done.wait(timeout):
        late.set()
        while not done.wait(0.5):
            spark.sparkContext.cancelJobGroup(group)


def run_passes(names: list[str], registry: dict[str, Callable], timeout: float | None = None, spark: SparkSession | None = None, **config) -> list[dict]:
    """Runs named passes one after another; an unknown, failing or (given a session) late pass is reported and
    the rest go on. After `timeout` seconds a pass's Spark jobs are cancelled, so it ends with an error."""
    out = []
    for name in names:
        if name not in registry:
            out.append({"pass": name, "ok": False, "error": "unknown pass"})
            continue
        done, late = threading.Event(), threading.Event()
        if spark is not None and timeout is not None:
            spark.sparkContext.setJobGroup(f"pass-{name}", f"maintenance pass {name}", True)
            threading.Thread(target=_watch, args=(spark, f"pass-{name}", timeout, done, late), daemon=True).start()
        try:
            out.append({"pass": name, "ok": True, "stats": registry[name](**config)})
        except Exception as e:  # noqa: BLE001  isolation of passes is the contract
            out.append({"pass": name, "ok": False, "error": f"timed out after {timeout} s" if late.is_set() else str(e)[:300]})
        finally:
            done.set()
            if spark is not None and timeout is not None:
                for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                    spark.sparkContext.setLocalProperty(k, None)
    return out


def reinforced(pairs: DataFrame, atoms: DataFrame, days: int = 30) -> DataFrame:
    """REINFORCED_BY edges (older, newer, similarity) of near-duplicate pairs (a, b) written within some days."""
    t = atoms.select("atom", "created_at")
    x = pairs.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b")
    gap = F.abs(F.unix_micros(F.col("ta").cast("timestamp")) - F.unix_micros(F.col("tb").cast("timestamp"))) <= days * 86_400_000_000
    first = (F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")))
    return x.where(gap).select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("newer"), "similarity")


def near_duplicates(vectors: DataFrame, queries: DataFrame, least: float = 0.92) -> DataFrame:
    """(a, b, similarity): stated query vectors against all, each pair once from its larger id."""
    return VectorIndex.build(vectors).within(queries.withColumnRenamed("id", "query"), least, 5).select(F.col("query").alias("a"), F.col("id").alias("b"), "similarity")


def summaries_due(mentions: DataFrame, atoms: DataFrame, least_atoms: int = 5, pairs: int | None = None) -> DataFrame:
    """(week, a, b, atoms): entity pairs that at least five atoms of a week share; pairs within an atom only. They
    are dealt as for so many pairs, if that is given."""
    m = mentions.select("atom", "entity").distinct().join(atoms.select("atom", F.date_trunc("week", "created_at").alias("week")), "atom")
    p = m.select("atom", "week", F.col("entity").alias("a")).join(m.select("atom", F.col("entity").alias("b")), "atom").where("a < b")
    return dealt(p.select("week", "a", "b"), pairs, "a", "b").groupBy("week", "a", "b").agg(F.count("*").alias("atoms")).where(F.col("atoms") >= least_atoms)


def summarizes(mentions: DataFrame, atoms: DataFrame, due: DataFrame) -> DataFrame:
    """SUMMARIZES edges (week, a, b, atom) of summaries that are due to the atoms they sum up."""
    m = mentions.select("atom", "entity").distinct().join(atoms.select("atom", F.date_trunc("week", "created_at").alias("week")), "atom")
    return due.select("week", "a", "b").join(m.withColumnRenamed("entity", "a"), ["week", "a"]).join(m.withColumnRenamed("entity", "b"), ["week", "b", "atom"]).select("week", "a", "b", "atom")


def archive_due(entities: DataFrame, as_of: Column, days: int = 365, least: int = 3) -> DataFrame:
    return entities.where((F.col("last_seen") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("mention_count") < least))


def theme_edges(themes: DataFrame) -> DataFrame:
    """IS_A edges (src, dst) from each node to the node that names its theme."""
    return themes.where("node <> theme").select(F.col("node").alias("src"), F.col("theme").alias("dst"))


def themes(edges: DataFrame, rounds: int = 3, least_weight: int = 2) -> DataFrame:
    """(node, theme): a few rounds of weighted label propagation over strong associations; ties to the least label."""
    e = edges.where(F.col("weight") >= least_weight)
    w = e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(e.select("b", "a", "weight"))
    label = w.select(F.col("src").alias("node")).distinct().withColumn("theme", F.col("node"))
    for _ in range(rounds):
        votes = w.join(label, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node"), "theme").agg(F.sum("weight").alias("v"))
        label = votes.groupBy("node").agg(F.max_by("theme", F.struct("v", -F.col("theme"))).alias("theme"))
    return label


def resolver_candidates(names: DataFrame, entities: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(mention, entity) from aliases and, given mention and entity vectors, from similarity. resolve.candidates
    merges all four indexes."""
    al = entities.select("entity", F.explode("aliases").alias("alias"))
    out = names.join(al, F.lower("name") == F.lower("alias")).select("mention", "entity")
    return out if vectors is None else out.union(nearest(vectors, names.select(F.col("mention").alias("query"), "vector"), 10, 0.4).select("query", "id")).distinct()
