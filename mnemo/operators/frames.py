"""Windows, top-k, budgets, keyed filters and upserts over any table."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors see. Only a session in one process (tests) gets a local
    folder where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="mnemo-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task that groups or joins rows which hardly combine.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """Dealt by keys over tasks of TASK_ROWS of so many rows, so that a task's memory stays as tables grow. What is
    grouped or joined by the keys after that is not dealt again. Few or unknown rows are left to Spark."""
    n = -(-(rows or 0) // TASK_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def only(df: DataFrame, keys: DataFrame | None, *cols: str) -> DataFrame:
    """Rows whose key columns occur in keys; all without keys."""
    return df if keys is None else df.join(keys.select(*cols).distinct(), list(cols), "left_semi")


def matching(df: DataFrame, equal: dict) -> DataFrame:
    """Equality filters; a list means any of them; None means null."""
    return df.where(reduce(and_, [F.col(k).isin(v) if isinstance(v, (list, tuple, set)) else F.col(k).eqNullSafe(F.lit(v)) for k, v in equal.items()], F.lit(True)))


def between(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Inclusive time range, open where a bound is None."""
    df = df if start is None else df.where(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    return df if end is None else df.where(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))


def page(df: DataFrame, key: list, limit: int = 100, skip: int = 0) -> DataFrame:
    return df.orderBy(*key).offset(skip).limit(limit)


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def top(df: DataFrame, by: list, order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group by a total order; Spark cuts groups before the shuffle."""
    out = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def within_budget(df: DataFrame, by: list, order: list, text: str, budget: int, n: int) -> DataFrame:
    """The longest prefix of each group, in order, whose texts fit a character budget, and at most n rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    run = F.sum(F.coalesce(F.length(text), F.lit(0))).over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("_used", run).where(F.col("_used") <= budget).drop("_r", "_used")


def latest(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The last row of each key by a total order, as one aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_x")).select("_x.*")


def upsert_nodes(old: DataFrame, new: DataFrame, keys: list, version: Column | None = None, created: str = "created_at") -> DataFrame:
    """New rows replace old ones of their key, columns and all, but the first created_at stays. Within
    the batch the greatest version wins, else the greatest row."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "_v"]
    order = F.struct(F.col("_v"), *( [version.alias("_o")] if version is not None else []), *[F.col(c) for c in names if not str(both.schema[c].dataType).startswith("Map")])
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("_x"), *([F.min(created).alias("_c")] if created in names else []))
    return out.select(*[(F.col("_c") if c == created else F.col(f"_x.{c}")).alias(c) for c in names])


def upsert_edges(old: DataFrame, new: DataFrame, keys: list, ends: list[tuple[DataFrame, dict[str, str]]] = (), overwrite: bool = False) -> DataFrame:
    """Edges whose ends exist (node table, {edge column: node column}); kept as first created, or overwritten."""
    for nodes, on in ends:
        k = nodes.select(*[F.col(b).alias(a) for a, b in on.items()]).distinct()
        new = new.join(k, list(on), "left_semi")
    new = new.groupBy(*keys).agg((F.max_by if overwrite else F.min_by)(F.struct(*new.columns), F.struct(*new.columns)).alias("_x")).select("_x.*")
    if overwrite:
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)
