"""Writes: atoms and their edges, associations, registry, status, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions.text import content_id
from mnemo.operators.frames import upsert_edges, upsert_nodes
from mnemo.operators.store import Store


def write_atoms(new: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Atoms (content, kind, salience, episode, supersedes, instance, cwd) to rows and their edges. Ids are
    hashes of what is written and when, so a retried task writes the same ids."""
    x = new.withColumn("created_at", as_of).withColumn("atom", content_id(F.concat_ws("|", "instance", "cwd", "content", as_of.cast("string")), 26))
    return {
        "atoms": x.drop("supersedes", "episode").withColumn("extracted", F.lit(False)).withColumn("access_count", F.lit(0).cast("long")),
        "in_episode": x.where("episode is not null").select("atom", "episode"),
        "supersedes": x.where("supersedes is not null").select("atom", F.col("supersedes").alias("prior"), "created_at"),
        "jobs": x.select("atom", F.lit(0).alias("attempts"), F.col("created_at").alias("next_at")),
    }


def publish_atoms(store: Store, new: DataFrame, as_of: Column, batch: str | None = None, stage: Callable | None = None) -> int | None:
    """Atoms, episode links, supersedes and jobs of one write, visible together or not at all; a batch that is
    already there changes nothing. The new rows are read once a table."""
    return store.append(write_atoms(new, as_of), batch, stage)


def mark_superseded(atoms: DataFrame, supersedes: DataFrame) -> DataFrame:
    """superseded_by from the latest edge of each prior atom."""
    last = supersedes.groupBy(F.col("prior").alias("_p")).agg(F.max_by("atom", F.struct("created_at", "atom")).alias("_by"))
    old = F.col("superseded_by") if "superseded_by" in atoms.columns else F.lit(None).cast("string")
    return atoms.join(last, F.col("atom") == F.col("_p"), "left").withColumn("superseded_by", F.coalesce("_by", old)).drop("_p", "_by")


def create_occurrences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions created where absent."""
    return upsert_edges(old, new, ["atom", "entity", "kind"])


def bump_mentions(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    n = mentions.groupBy(F.col("entity").alias("_e")).agg(F.count("*").alias("_n"), F.max("created_at").alias("_t"))
    x = entities.join(n, F.col("entity") == F.col("_e"), "left")
    return x.withColumn("mention_count", F.col("mention_count") + F.coalesce("_n", F.lit(0))).withColumn("last_seen", F.greatest("last_seen", F.coalesce("_t", F.col("last_seen")))).drop("_e", "_n", "_t")


def cleared(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes (label, id) and edges (src_label, src, dst_label, dst) without some labels and all edges at them."""
    return nodes.where(~F.col("label").isin(labels)), edges.where(~F.col("src_label").isin(labels) & ~F.col("dst_label").isin(labels))


def register(instances: DataFrame, new: DataFrame) -> DataFrame:
    return upsert_nodes(instances, new.withColumn("status", F.lit("active")), ["name"])


def unregister(instances: DataFrame, names: DataFrame) -> DataFrame:
    """Soft delete."""
    x = instances.join(names.select(F.col("name").alias("_n")).distinct(), F.col("name") == F.col("_n"), "left")
    return x.withColumn("status", F.when(F.col("_n").isNotNull(), "removed").otherwise(F.col("status"))).drop("_n")


def parents(instances: DataFrame) -> DataFrame:
    """PARENT_OF edges of active instances whose parent is registered."""
    act = instances.where("status = 'active'")
    return act.where("parent is not null").join(act.select(F.col("name").alias("parent")), "parent", "left_semi").select(F.col("parent").alias("src"), F.col("name").alias("dst"))


def recent_per_instance(activities: DataFrame, n: int = 20) -> DataFrame:
    from mnemo.operators.frames import top

    return top(activities, ["instance"], [F.desc("ts"), "source_id"], n)


def status(tables: dict[str, DataFrame], cursor: DataFrame) -> DataFrame:
    """Counts of tables and cursors by time, as JSON-ready rows."""
    from mnemo.operators.maintain import counts

    c = counts(tables).select(F.lit("count").alias("section"), F.col("what").alias("name"), F.col("n").cast("string").alias("value"))
    return c.union(cursor.select(F.lit("cursor"), F.concat_ws(":", "source", "container"), F.col("latest").cast("string"))).orderBy("section", F.desc("value"), "name")


def run_record(name: str, stats: DataFrame, as_of: Column) -> DataFrame:
    """One maintenance-run row with its statistics as JSON."""
    return stats.agg(F.to_json(F.collect_list(F.struct(*stats.columns))).alias("stats")).select(F.lit(name).alias("pass"), as_of.alias("run_at"), "stats")
