import datetime as dt

import numpy as np

from mnemo.operators import vectors as V
from mnemo.operators.vectors import VectorIndex, near_copies


def frame(spark, rows, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{key} long, vector array<float>")


def brute(rows, queries, k, least=-9.0, digits=6):
    out = []
    for q, a in queries:
        sims = sorted((-float(V.rounded(np.dot(np.float32(a).astype(float), np.float32(b).astype(float)), digits)), i) for i, b in rows if i != q)
        out += [(q, i, -s) for s, i in sims[:k] if -s >= least]
    return sorted(out)


def clustered(rng, n, dim=16, centres=12):
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(df):
    return sorted((r["query"], r["id"], r["similarity"]) for r in df.collect())


def test_search_equals_brute_force_with_many_copies(spark):
    rng = np.random.default_rng(1)
    x = clustered(rng, 400)
    rows = list(enumerate(x)) + [(1000 + i, x[3]) for i in range(200)]
    index = VectorIndex.build(frame(spark, rows), k=24, block=50)
    queries = [r for r in rows if r[0] % 20 == 0]
    assert rows_of(index.search(frame(spark, queries, "query"), 5)) == brute(rows, queries, 5)


def test_pruning_leaves_most_lists_out(spark):
    rng = np.random.default_rng(2)
    x = clustered(rng, 2000, centres=40)
    index = VectorIndex.build(frame(spark, list(enumerate(x))), k=40)
    b = index.bounds(x[:50].astype(np.float32).astype(float))
    s = x[:50] @ x.T
    assert (b.max(axis=1) >= np.sort(s, axis=1)[:, -2] - 1e-5).all()
    assert (b >= np.sort(s, axis=1)[:, -6][:, None]).mean() < 0.4


def test_within_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 150)
    rows = list(enumerate(x))
    odd = spark.createDataFrame([(900, None), (901, [1.0, 2.0]), (902, [None] * 16)], "id long, vector array<float>")
    items = frame(spark, rows).union(odd)
    index = VectorIndex.build(items, unit=False, k=10, block=40)
    found = rows_of(index.within(items.withColumnRenamed("id", "query"), 0.8))
    y = np.float32(x).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = V.rounded(y @ y.T, 6)
    assert found == sorted((i, j, s[i, j]) for i in range(150) for j in range(i) if s[i, j] >= 0.8)
    none = frame(spark, [])
    assert VectorIndex.build(none).search(none.withColumnRenamed("id", "query")).collect() == []
    assert VectorIndex.build(items).search(none.withColumnRenamed("id", "query")).collect() == []


def test_near_copies_keep_every_link(spark):
    rng = np.random.default_rng(4)
    base = clustered(rng, 6, 8, 6)
    near = base + 0.05 * rng.normal(size=base.shape)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    t0, atoms = dt.datetime(2024, 1, 1), []
    for i in range(240):
        v = (base, near)[i % 2][i % 6] if i % 3 else base[0]  # one vector holds a third
        atoms.append((i, [float(a) for a in v], t0 + dt.timedelta(days=int(rng.integers(0, 300)), seconds=i)))
    out = near_copies(spark.createDataFrame(atoms, "id long, vector array<float>, ts timestamp")).collect()
    ts, vec = {i: t for i, _, t in atoms}, {i: np.array(v) for i, v, _ in atoms}
    assert all((ts[r.older], r.older) < (ts[r.newer], r.newer) and ts[r.newer] - ts[r.older] <= dt.timedelta(days=30) and vec[r.older] @ vec[r.newer] > 0.9199 for r in out)
    up = {i: i for i in ts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in out:
        up[top(r.older)] = top(r.newer)
    for i in ts:
        for j in range(i):
            if abs(ts[i] - ts[j]) <= dt.timedelta(days=30) and round(float(vec[i] @ vec[j]), 5) > 0.92:
                assert top(i) == top(j)
    assert len(out) < 5 * len(ts)


def test_a_query_moves_once_a_shelf_and_not_once_a_list(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))  # without clusters no list is cut
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x))
    index = VectorIndex.build(frame(spark, rows), k=30, block=100)
    probes = index._probes(index._ready(frame(spark, rows, "query"), -9.0))
    assert len(index.centres) == 30 and probes.count() <= 5 * len(rows)
    assert rows_of(index.search(frame(spark, rows, "query"), 7)) == brute(rows, rows, 7)
    assert rows_of(index.search(frame(spark, rows, "query"), 300, 0.3)) == brute(rows, rows, 300, 0.3)


def test_few_queries_meet_all_rows_without_lists(spark, monkeypatch):
    from mnemo.operators import search

    monkeypatch.setattr(V, "fit_centres", lambda *a: 1 / 0)  # before, lists were fitted and all rows dealt for any query
    rng = np.random.default_rng(8)
    x = clustered(rng, 300)
    rows = list(enumerate(x)) + [(1000 + i, x[3]) for i in range(60)] + [(2000, 7 * x[5]), (2001, 0 * x[5]), (2002, -x[3])]
    odd = spark.createDataFrame([(900, None), (901, [1.0, 2.0]), (902, [None] * 16), (903, [float("nan")] * 16)], "id long, vector array<float>")
    queries = [r for r in rows if r[0] % 20 == 0] + [rows[-2]]
    asked = frame(spark, queries, "query").union(odd)
    for bound in (40, V.BLOCK):
        assert rows_of(search.nearest(frame(spark, rows).union(odd), asked, 5, bound=bound)) == brute(rows, queries, 5)
    assert rows_of(search.nearest(frame(spark, rows), asked, 5, 0.4)) == brute(rows, queries, 5, 0.4)
    assert search.nearest(odd.limit(0), asked).collect() == search.nearest(odd.where("id = 900"), asked).collect() == []
    monkeypatch.setattr(search, "FEW_QUERIES", 3)
    monkeypatch.setattr(V, "fit_centres", lambda x, k: np.eye(k, x.shape[1]))
    assert rows_of(search.nearest(frame(spark, rows), asked, 5)) == brute(rows, queries, 5)
