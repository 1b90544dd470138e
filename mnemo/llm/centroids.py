"""Centroid clustering with ns-bounds on whole-number vectors.

Each vector keeps, for every centroid, the distance at its last evaluation and the round of that
evaluation. The centroids of all rounds are kept, so a stored distance is loosened by the norm of the
centroid's displacement since that round (not by the sum of its moves in the rounds between). Only
centroids whose lower bound does not clear the upper bound of the vector's own are evaluated again, on
whole numbers, so that assignments, ties and sums are exact. State is a table in the shared folder, one
a round; the driver holds the k centroids of each round and their sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm.common import drop_path, saved, scratch_path

#: Largest whole number of a component: squared distances of 64 components then stay below 2**63.
LARGEST = 2**27
#: Part of a stored distance that covers rounding when bounds are compared.
SLACK = 1e-9

#: Ids go as text: as numbers, ids beside nulls would turn into floats.
STATE = "vec_id string, vec binary, cluster int, distance long, roots binary, stamps binary, evaluated int"


def whole_vectors(embeddings: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, vec): vectors of exactly dim components, none null or non-finite, as floor(scale * x) in
    little-endian 64-bit integers. Raises where such a number exceeds LARGEST in size."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.floor(scale * np.stack(f["embedding"].to_numpy()).astype(np.float64))
                if np.abs(x).max() > LARGEST:
                    raise ValueError(f"components beyond {LARGEST // scale} in size have no exact distance")
                yield pd.DataFrame({"vec_id": f["vec_id"], "vec": [v.tobytes() for v in x.astype("<i8")]})

    x = F.col("embedding")
    fine = F.coalesce(F.size(x) == dim, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return embeddings.where(fine).select(F.col("vec_id").cast("string").alias("vec_id"), x.cast("array<double>").alias("embedding")).mapInPandas(packed, "vec_id string, vec binary")


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`; equal ones by id and components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("vec_id", F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), F.col("vec_id").cast("long").alias("vec_id"), "vec").orderBy("key", "vec_id", "vec").limit(k).collect()
    return np.stack([np.frombuffer(r.vec, dtype="<i8") for r in rows]) if rows else np.empty((0, 0), dtype=np.int64)


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=-1)


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1).copy()


def assigned(x: np.ndarray, history: np.ndarray, cluster: np.ndarray, roots: np.ndarray, stamps: np.ndarray, last: bool) -> tuple[np.ndarray, ...]:
    """One assignment of rows x to history[-1]: (cluster, distance, roots, stamps, evaluated).

    roots and stamps are changed in place. A distance is only exact where it was evaluated now, which
    holds for all rows when last is set."""
    now, n, k = len(history) - 1, len(x), history.shape[1]
    rows = np.arange(n)
    distance, evaluated = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int32)
    if now == 0:
        d = np.stack([_exact(x, c) for c in history[0]], axis=1)
        cluster = d.argmin(axis=1)
        roots[:], stamps[:] = np.sqrt(d.astype(np.float64)), 0
        return cluster, d[rows, cluster], roots, stamps, evaluated + k
    moved = np.sqrt(((history[-1][None] - history).astype(np.float64) ** 2).sum(axis=2))  # (round, centroid)
    drift = moved[stamps, np.arange(k)]
    low = (roots - drift) - SLACK * (1 + roots + drift)
    own = roots[rows, cluster] + drift[rows, cluster]
    low[rows, cluster] = np.inf
    touch = np.flatnonzero((low <= (own * (1 + SLACK) + SLACK)[:, None]).any(axis=1) | last)
    if not len(touch):
        return cluster, distance, roots, stamps, evaluated
    a = cluster[touch]
    d = _exact(x[touch], history[-1][a])
    roots[touch, a], stamps[touch, a] = np.sqrt(d.astype(np.float64)), now
    distance[touch], evaluated[touch] = d, 1
    fails = low[touch] <= (roots[touch, a] * (1 + SLACK) + SLACK)[:, None]
    best, to = d.copy(), a.copy()
    for j in range(k):  # k passes, each over the rows that failed at this centroid
        at = np.flatnonzero(fails[:, j])
        if not len(at):
            continue
        row = touch[at]
        dj = _exact(x[row], history[-1][j])
        roots[row, j], stamps[row, j] = np.sqrt(dj.astype(np.float64)), now
        evaluated[row] += 1
        wins = (dj < best[at]) | ((dj == best[at]) & (j < to[at]))
        best[at[wins]], to[at[wins]] = dj[wins], j
    cluster = cluster.copy()
    cluster[touch], distance[touch] = to, best
    return cluster, distance, roots, stamps, evaluated


def _round(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    k = history.shape[1]

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["vec"], "<i8")
            if len(history) == 1:
                c, r, s, e = np.zeros(len(f), dtype=np.int64), np.empty((len(f), k)), np.empty((len(f), k), dtype=np.uint8), 0
            else:
                c, r, s, e = f["cluster"].to_numpy().astype(np.int64), _matrix(f["roots"], "<f8"), _matrix(f["stamps"], "u1"), f["evaluated"].to_numpy()
            c, d, r, s, now = assigned(x, history, c, r, s, last)
            yield pd.DataFrame({"vec_id": f["vec_id"], "vec": f["vec"], "cluster": c, "distance": d, "roots": [v.tobytes() for v in r], "stamps": [v.tobytes() for v in s], "evaluated": e + now})

    return state.mapInPandas(step, STATE)


def _sums(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[list[int]]]:
    """Counts and component sums of each cluster: summed by batch, then by Spark; k * dim numbers come back."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, c = _matrix(f["vec"], "<i8"), f["cluster"].to_numpy()
                for j in np.unique(c):
                    yield pd.DataFrame({"cluster": [j], "n": [int((c == j).sum())], "sums": [x[c == j].sum(axis=0)]})

    parts = state.select("cluster", "vec").mapInPandas(partial, "cluster int, n long, sums array<long>")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    counts, sums = np.zeros(k, dtype=np.int64), [[0] * dim for _ in range(k)]
    for r in rows:
        counts[r.cluster], sums[r.cluster][r.at] = r.n, int(r.x)
    return counts, sums


def cluster(vectors: DataFrame, start: np.ndarray, rounds: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, evaluated) of every row of vectors (vec_id, vec), and the centroids of all
    rounds. evaluated counts the distances that were computed for the row in all rounds together."""
    spark = vectors.sparkSession
    k, dim = start.shape
    history, state, old = start[None], vectors, None
    for r in range(rounds + 1):
        path = scratch_path(spark, "centroids")
        _round(state, history, r == rounds).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if old is not None:
            drop_path(spark, old)
        old = path
        if r < rounds:
            counts, sums = _sums(state, k, dim)
            moved = [[s // int(n) for s in row] if n else list(was) for n, row, was in zip(counts, sums, history[-1], strict=True)]
            history = np.concatenate([history, np.array(moved, dtype=np.int64)[None]])
    return state.select("vec_id", "cluster", "distance", "evaluated"), history


def centroid_sha256(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()


def describe(spark: SparkSession, embeddings: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    Null, short, long and non-finite vectors are left out; fewer than k vectors make fewer centroids; an
    empty table gives no rows; repeated rows stay and count each; a null vec_id hashes as the empty
    string; ties go to the smaller centroid; other columns of the input are not carried."""
    vectors = saved(whole_vectors(embeddings, dim), "vectors")
    start = first_centroids(vectors, k)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows, history = cluster(vectors, start, rounds)
    found = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(j, s, sum(found.values()), centroid_sha256(history[-1][j])) for j, s in found.items()]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3) -> str:
    near = """a{r} AS (SELECT vec_id, v, arg_min(c, [d, c]) AS c, min(d) AS d FROM (
      SELECT vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT AS d FROM x, c{r}) GROUP BY vec_id, v)"""
    move = """s{r} AS (SELECT c, i, sum(t)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS t, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i),
    m{r} AS (SELECT c, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS w FROM s{r} GROUP BY c),
    c{q} AS (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))"""
    parts = [near.format(r=0)]
    for r in range(rounds):
        parts += [move.format(r=r, q=r + 1), near.format(r=r + 1)]
    return f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY h, vec_id) - 1)::INT AS c, v AS w FROM (
  SELECT *, sha256('1:' || vec_id::VARCHAR) AS h FROM x ORDER BY h, vec_id LIMIT {k})),
{", ".join(parts)}
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


SQL = _sql()
