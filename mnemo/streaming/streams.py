"""Streams: incremental ingest, event-log subscriptions, correlation, episodes, rates, cascades."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators.frames import upsert_nodes
from mnemo.operators.store import Store
from mnemo.sources.readers import ENVELOPE


def landing(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """JSON files as they land; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("mode", "DROPMALFORMED").json(path)


def ingest(stream: DataFrame, table: str, keys: list[str], checkpoint: str, transform: Callable = lambda d: d):
    """Runs to the end of what has landed, upserting each batch into a table folder by its keys.

    A batch writes version n of the folder from version n - 1 and is skipped if n is already there, so a
    batch that is tried again changes nothing.
    """

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = transform(batch)
        old = spark.read.schema(new.schema).parquet(f"{table}/v={n - 1}") if n else spark.createDataFrame([], new.schema)
        upsert_nodes(old, new, keys).write.mode("overwrite").parquet(f"{table}/v={n}")

    q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest_touched(stream: DataFrame, store: Store, table: str, keys: list[str], checkpoint: str, transform: Callable = lambda d: d, buckets: int = 64):
    """Runs to the end of what has landed, upserting each batch into a table of a store: only the buckets of keys
    that a batch touches are read and rewritten. A batch that is tried again changes nothing."""

    def upsert(batch: DataFrame, n: int) -> None:
        store.upsert(table, transform(batch), keys, n, buckets)

    q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream of envelopes; log files must be closed (rolled) when they land."""
    return landing(spark, path, ENVELOPE)


def subscribe(stream: DataFrame, kinds: list[str] = ("*",), source: str | None = None, own: str | None = None) -> DataFrame:
    """Envelopes of some kinds and a source, without those that `own` wrote itself."""
    out = stream if "*" in kinds else stream.where(F.col("kind").isin(list(kinds)))
    out = out if source is None else out.where(F.col("source") == source)
    return out if own is None else out.where(F.col("source") != own)


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each id once within a delay."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def correlate(requests: DataFrame, replies: DataFrame, timeout: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Requests with their replies within a timeout; a request without any comes out once, with null reply.
    Works on streams (with watermarks) and on tables."""
    q = requests.select(F.col("id").alias("request"), F.col("timestamp").alias("asked"), F.col("data").alias("query"))
    r = replies.select(F.col("replyTo").alias("_to"), F.col("id").alias("reply"), F.col("timestamp").alias("answered"), F.col("source").alias("replier"))
    if requests.isStreaming:
        q, r = q.withWatermark("asked", late), r.withWatermark("answered", late)
    return q.join(r, (F.col("request") == F.col("_to")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {timeout}")), "left_outer").drop("_to")


def rates(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """Counts of kinds in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def session_episodes(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Episodes by gaps of silence for each instance and folder."""
    w = F.session_window("timestamp", gap)
    return stream.withWatermark("timestamp", late).groupBy(w.alias("w"), "instance", "cwd").agg(F.count("*").alias("messages")).select("instance", "cwd", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


EPISODE = "instance string, cwd string, number long, messages long, first timestamp, last timestamp, closed boolean"


def _episodes(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    number, messages, first, last = state.get if state.exists else (0, 0, None, None)
    rows = pd.concat(list(frames)).sort_values(["timestamp", "kind"])
    out = []
    for kind, ts in zip(rows["kind"], rows["timestamp"], strict=True):
        first, last, messages = first or int(ts.value // 1000), int(ts.value // 1000), messages + (kind != "close")
        if kind == "close":
            out.append((*key, number, messages, first, last, True))
            number, messages, first, last = number + 1, 0, None, None
    if messages:
        out.append((*key, number, messages, first, last, False))
    state.update((number, messages, first, last))
    f = pd.DataFrame(out, columns=[c.split()[0] for c in EPISODE.split(", ")])
    for c in ("first", "last"):
        f[c] = pd.to_datetime(f[c], unit="us")
    yield f


def open_close_episodes(stream: DataFrame) -> DataFrame:
    """Episodes of (instance, cwd) that a `close` event ends: state is the open episode. Each batch gives the
    closed ones and the state of the open one (update mode)."""
    return stream.groupBy("instance", "cwd").applyInPandasWithState(_episodes, EPISODE, "number long, messages long, first long, last long", "update", "NoTimeout")


def batch_episodes(events: DataFrame) -> DataFrame:
    """The same episodes of a table: the number of close events before a row names its episode."""
    from pyspark.sql import Window

    w = Window.partitionBy("instance", "cwd").orderBy("timestamp", "kind").rowsBetween(Window.unboundedPreceding, -1)
    x = events.withColumn("number", F.coalesce(F.sum(F.when(F.col("kind") == "close", 1).otherwise(0)).over(w), F.lit(0)))
    return x.groupBy("instance", "cwd", "number").agg(F.count_if(F.col("kind") != "close").alias("messages"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.max(F.col("kind") == "close").alias("closed"))


JOB = "atom string, status string, attempts long, next_at timestamp, changed_at timestamp, error string"
_JOB_STATE = "status string, attempts long, next_at long, changed_at long, claimed_at long, error string"
#: Attempts before a job is given up, seconds of the first wait, seconds after which a claim without an end is stale.
MOST_ATTEMPTS, WAIT, STALE = 5, 2, 300


def job_step(job: tuple | None, kind: str, at: int, error: str | None = None) -> tuple:
    """A job (status, attempts, next_at, changed_at, claimed_at, error) after an event at a time in microseconds.

    enqueue starts a job unless one is open; claim counts an attempt; done ends it; failed puts it back with
    a wait that doubles with each attempt, or after MOST_ATTEMPTS gives it up (`failed`); stale puts an
    unfinished claim back at once. A claim of what is not queued, and an end of what is not claimed, change nothing."""
    status, attempts, next_at, changed, claimed, said = job or (None, 0, None, None, None, None)
    if status == "in_progress" and kind in ("claim", "enqueue") and at >= claimed + STALE * 1_000_000:
        status, attempts, next_at, changed, claimed, said = job_step(job, "stale", claimed + STALE * 1_000_000)
    if kind == "enqueue" and status in (None, "done"):
        return "queued", 0, at, at, None, None
    if kind == "claim" and status == "queued" and at >= next_at:
        return "in_progress", attempts + 1, None, at, at, None
    if kind == "done" and status == "in_progress":
        return "done", attempts, None, at, None, None
    if kind == "failed" and status == "in_progress":
        if attempts >= MOST_ATTEMPTS:
            return "failed", attempts, None, at, None, error
        return "queued", attempts, at + WAIT * 1_000_000 * 2 ** (attempts - 1), at, None, error
    if kind == "stale" and status == "in_progress":
        return "queued", attempts, at, at, None, "stale claim"
    return status, attempts, next_at, changed, claimed, said


def _jobs(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    job = tuple(state.get) if state.exists else None
    before = job
    if state.hasTimedOut:
        job = job_step(job, "stale", job[4] + STALE * 1_000_000)
    else:
        rows = pd.concat(list(frames)).sort_values("timestamp", kind="stable")
        for kind, at, error in zip(rows["kind"], rows["timestamp"], rows["error"], strict=True):
            job = job_step(job, kind, int(at.value // 1000), error)
    if job is not None and job[0] == "in_progress":
        late = (job[4] + STALE * 1_000_000) // 1000
        if late > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(late)
        else:
            job = job_step(job, "stale", job[4] + STALE * 1_000_000)
    if job is None or job[0] is None or job == before:
        return
    state.update(job)
    f = pd.DataFrame([(*key, *job[:4], job[5])], columns=[c.split()[0] for c in JOB.split(", ")])
    for c in ("next_at", "changed_at"):
        f[c] = pd.to_datetime(f[c], unit="us")
    yield f


def job_states(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """The state of each atom's extraction job after each batch of events (atom, kind, timestamp, error): rows JOB in
    update mode. State is one row an atom; a claim has a timer by event time."""
    return events.withWatermark("timestamp", late).groupBy("atom").applyInPandasWithState(_jobs, JOB, _JOB_STATE, "update", "EventTimeTimeout")


def work_queue(events: DataFrame, store: Store, checkpoint: str, late: str = "1 minute"):
    """Runs to the end of what has landed and writes attempts, next times and given-up jobs back: tables `jobs` and
    `dead_letters` of a store change together, a batch once."""

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.persist()
        try:
            store.upserts({"jobs": (rows, ["atom"]), "dead_letters": (rows.where("status = 'failed'"), ["atom"])}, n)
        finally:
            rows.unpersist()

    q = job_states(events, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def claimable(jobs: DataFrame, as_of, n: int = 100) -> DataFrame:
    """The first n queued jobs that are due, oldest first."""
    return jobs.where("status = 'queued'").where(F.col("next_at") <= F.lit(as_of).cast("timestamp")).orderBy("next_at", "atom").limit(n)


def cascade(batch: DataFrame, own: str, parent: str, instance: str) -> None:
    """A child's atoms into its own table and its parent's: there with their episode as a foreign one only."""
    batch.write.mode("append").parquet(own)
    up = batch.withColumn("foreign_episode", F.struct(F.lit(instance).alias("instance"), F.col("episode").cast("string").alias("episode_id"))).withColumn("episode", F.lit(None).cast(batch.schema["episode"].dataType))
    up.write.mode("append").parquet(parent)
