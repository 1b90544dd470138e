"""Near-copies are compared where their windows meet; similar pairs that are far apart in time are not kept."""

import datetime as dt

import numpy as np
import pytest

from mnemo.operators import vectors as V
from tests.test_packages_grid import shuffled

DAY = dt.timedelta(days=1)


def brute(atoms, least, digits=5, span=30 * 86_400_000_000):
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    own = {}
    for i, v, t in atoms:
        own.setdefault((tuple(v), us(t) // span), []).append((us(t), i))
    out = []
    for (v, w), rows in own.items():
        first, last = min(rows), max(rows)
        out += [(first[1], i, 1.0) for t, i in rows if i != first[1]]
        for (o, u), others in own.items():
            s = 1.0 if o == v else float(V.rounded(np.array([np.dot(v, o)]), digits)[0]) if len(v) == len(o) else 0
            a, b = (first, min(others)) if u == w else (last, min(others))
            if (u == w and v < o or u == w + 1) and s > least and abs(b[0] - a[0]) <= span:
                out.append((min(a, b)[1], max(a, b)[1], s))
    return sorted(out)


def some(n, kinds, days, rng):
    x = np.float32(rng.normal(size=(kinds, 8)) + 0.7)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(a) for a in np.float32(x[rng.integers(kinds)])], dt.datetime(2024, 1, 1) + DAY * int(rng.integers(days)) + dt.timedelta(seconds=i)) for i in range(n)]


@pytest.mark.parametrize("block", [16_000, 9])
def test_near_copies_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(1)
    atoms = some(150, 60, 200, rng)
    odd = [(900, [0.5, 0.9], dt.datetime(2024, 1, 5)), (901, [0.6, 0.9], dt.datetime(2024, 1, 6)), (902, None, dt.datetime(2024, 1, 5)), (903, [None] * 8, dt.datetime(2024, 1, 5)), (904, [None] * 8, dt.datetime(2024, 1, 6)), (905, atoms[0][1], None)]
    out = V.near_copies(spark.createDataFrame(atoms + odd, "id long, vector array<double>, ts timestamp_ntz"), 0.5).collect()
    want = brute(atoms + odd[:2], 0.5) + [(903, 904, 1.0)]
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_pairs_far_apart_in_time_are_not_kept(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(some(500, 500, 3000, rng), "id long, vector array<double>, ts timestamp_ntz")
    out, rows = shuffled(spark, lambda: V.near_copies(df, -2.0).collect())
    assert rows < 10 * 500 and len(out) < 10 * 500  # all 124,750 pairs are alike
