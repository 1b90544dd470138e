"""What the corpus operators share: tables, scratch tables in the shared folder, words, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but these.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a session in one process (tests) gets a local one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="mnemo-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over; else they stay until the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Lower-case A-Z only, then split on ASCII white space; null and blank texts have no words."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACES), lambda w: w != "")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: inside another lambda Spark would repeat it for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """A broadcast hint only for a side whose counted size is under the limit; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node reachable.

    Each round hooks every node to the least label of its neighbours and then follows that label's
    own label once, so chains shrink fast. State stays in tables; only a count comes to the driver.
    """
    both = saved(
        edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(),
        tag + "-edges",
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        labels = saved(labels, tag)
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        step = saved(hooked.join(up, "low", "left").select("node", "label", F.least("low", F.coalesce("top", "low")).alias("next")), tag)
        moved = step.where("next <> label").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
