"""Pairs of members of the same sets, and steps over a node, are met without a shuffled row a pair."""

import random

import pytest

from mnemo.operators import graph, grid


def brute_pairs(uses):
    sets, found = {}, {}
    for p, d in uses:
        if d is not None:
            sets.setdefault(d, set()).add(p)
    for own in sets.values():
        known = sorted(p for p in own if p is not None)
        for i, a in enumerate(known):
            for b in known[i + 1 :]:
                n, most = found.get((a, b), (0, 0))
                found[a, b] = n + 1, max(most, len(own))
    return sorted((*k, *v) for k, v in found.items())


@pytest.mark.parametrize("block", [None, 25])
def test_shared_pairs_equal_brute_force(spark, block):
    rng = random.Random(5)
    uses = [(rng.randrange(90), rng.randrange(50)) for _ in range(1500)] + [(None, 3), (4, None), (200, 900), (None, None), *((p, 77) for p in range(0, 90, 2))]
    got = grid.shared_pairs(spark.createDataFrame(uses, "member long, set long"), len(uses), block).collect()
    assert sorted(tuple(r) for r in got) == brute_pairs(uses)


def test_shared_pairs_some_at_a_time(monkeypatch):
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(40), rng.randrange(2, 30))) for _ in range(60)]
    np = grid.np
    flat, n = np.concatenate(sets).astype("u2"), np.array([len(s) for s in sets])
    cell = {"users": n, "lefts": n, "rights": n, "left": flat, "right": flat, "left_names": np.arange(40), "right_names": np.arange(40)}
    want = brute_pairs([(p, d) for d, s in enumerate(sets) for p in s])
    for most in (10_000, 100, 5):
        monkeypatch.setattr(grid, "CHUNK", most)
        got = [tuple(int(x) for x in row) for part in grid._shared(cell, True) for row in zip(*part)]
        assert sorted(got) == want, most


@pytest.mark.parametrize("p,block", [(0.05, None), (0.02, 20)])
def test_unmet_equals_brute_force(spark, p, block):
    rng = random.Random(int(p * 100))
    n = 70
    step = {(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < p} | {(3, x) for x in range(n) if x != 3} | {(x, 3) for x in range(0, n, 3)}
    asks = {(a, b) for a in range(0, n, 2) for b in range(n) if rng.random() < 0.3}
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), names)
    got = grid.unmet(frame({(b, a) for a, b in step}, "set long, left long"), frame(step, "set long, right long"), frame(asks, "left long, right long"), 2 * len(step), block)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b) for a, b in asks if not any((a, m) in step and (m, b) in step for m in range(n)))


def test_untold_hubs_and_chunks(monkeypatch):
    np, rng = grid.np, random.Random(8)
    lefts = [rng.sample(range(50), rng.randrange(1, 9)) for _ in range(80)] + [list(range(50))]
    rights = [rng.sample(range(60), rng.randrange(1, 9)) for _ in range(80)] + [list(range(0, 60, 7))]
    asks = sorted({(rng.randrange(50), rng.randrange(60)) for _ in range(700)})
    told = {(a, b) for x, y in zip(lefts, rights) for a in x for b in y}
    size = lambda x: np.array([len(s) for s in x])
    cell = {"lefts": size(lefts), "rights": size(rights), "left": np.concatenate(lefts).astype("u2"), "right": np.concatenate(rights).astype("u2"), "left_names": np.arange(50), "right_names": np.arange(60)}
    cell["asks"] = [np.array(x) for x in zip(*asks)]
    for most, area, look in ((10_000, 10_000, 8), (7, 100, 1), (7, 10_000, 2)):
        for name, value in (("CHUNK", most), ("AREA", area), ("LOOK", look)):
            monkeypatch.setattr(grid, name, value)
        assert [divmod(int(x), 60) for x in grid._untold(cell)] == [k for k in asks if k not in told]


def test_very_many_pairs_go_to_the_grid(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOOK_PAIRS", 10)
    monkeypatch.setattr(grid, "groups", lambda *a: 2)
    n, rng = 150, random.Random(3)
    edges = sorted({(a, rng.randrange(n)) for a in range(n) for _ in range(14)} | {(a, (a + 1) % n) for a in range(n)})
    edges = [(a, b) for a, b in edges if a != b]
    frame = spark.createDataFrame(edges, "src long, dst long")
    a, roots = graph.Adjacency(frame), spark.createDataFrame([(r,) for r in range(n)], "root long")
    asked, have = [], grid.unmet
    monkeypatch.setattr(grid, "unmet", lambda *x: asked.append(1) or have(*x))
    left = {tuple(r) for r in a.unmet(a.first(roots), a.lone(roots)).collect()}
    step = set(edges)
    assert left == {(b, x) for x, b in step if (b, x) not in step and not any((b, m) in step and (m, x) in step for m in range(n))} and asked
