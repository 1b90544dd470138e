import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from mnemo.llm import centroids as c


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else str(i)
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{name(r[0])}".encode()).hexdigest(), -1 if r[0] is None else r[0], r[1]))[:k]
    cents = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    by = {}
    for _, j, d in last:
        by[j] = by.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in cents]
    return sorted(((-1 if i is None else i), j, d, by[j], sum(by.values()), sha[j]) for i, j, d in last)


def rows_of(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, cluster string"


def test_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    mid = rng.normal(size=(9, 64))
    rows = [(i, (mid[i % 9] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a third of all rows is one vector
    rows += [rows[3], rows[3], (None, rows[5][1]), (2000, None), (2001, [1.0] * 63), (2002, [1.0] * 65), (2003, [float("nan")] + [0.0] * 63), (2004, [float("inf")] + [0.0] * 63), (2005, [None] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    assert rows_of(c.describe(spark, df)) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    assert rows_of(c.describe(spark, df)) == brute(rows)
    assert c.describe(spark, df.where("vec_id < 0")).collect() == []


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-64, 64, (3000, 8)) + 300 * rng.integers(0, 5, (3000, 1))
    history = x[:12][None].astype(np.int64)
    cl, _, roots, stamps, total = c.assigned(x, history, np.zeros(3000, dtype=np.int64), np.empty((3000, 12)), np.empty((3000, 12), dtype=np.uint8), False)
    for r in range(6):
        new = np.stack([x[cl == j].sum(axis=0) // max(1, (cl == j).sum()) if (cl == j).any() else history[-1][j] for j in range(12)])
        history = np.concatenate([history, new[None]])
        cl, d, roots, stamps, n = c.assigned(x, history, cl, roots, stamps, r == 5)
        full = ((x[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (cl == full.argmin(axis=1)).all()
        total = total + n
    assert (d == full.min(axis=1)).all()
    assert total.sum() < 0.6 * 7 * 12 * 3000


def test_rounds_keep_each_others_rows(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist(), "x") for i in range(300)], SCHEMA)
    v = c.whole_vectors(df)
    out, history = c.cluster(v, c.first_centroids(v, 4), rounds=2)
    assert history.shape == (3, 4, 64) and out.count() == 300
    assert out.agg(F.sum("evaluated")).head()[0] <= 3 * 4 * 300
