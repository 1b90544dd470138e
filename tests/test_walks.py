import random

import pytest

from mnemo.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def levels(edges, root, hops):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
    seen, front = {root: 0}, {root}
    for d in range(1, hops + 1):
        front = {b for a in front for b in near.get(a, ())} - seen.keys()
        seen |= dict.fromkeys(front, d)
    return {n: d for n, d in seen.items() if d}


def brute_impact(edges, roots, depth, most):
    out = []
    for r in roots:
        down = {n: ("downstream", d) for n, d in levels(edges, r, depth).items()}
        rows = down | {a: ("dependent", 1) for a, b in edges if b == r and a is not None and a != r and a not in down}
        out += sorted((d, k, n, r) for n, (k, d) in rows.items())[:most]
    return sorted((r, n, k, d) for d, k, n, r in out)


@pytest.mark.parametrize("n,p,depth,most", [(40, 0.3, 2, 10), (60, 0.05, 2, 8), (60, 0.04, 3, 6), (30, 0.08, 4, 5), (25, 0.02, 4, 50)])
def test_impact_equals_brute_force(spark, n, p, depth, most):
    rng = random.Random(n * depth)
    edges = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < p]
    edges += [(5, 5), (None, 3), (3, None), *edges[:7]]
    roots = [*range(0, n, 3), 3, 999]
    got = graph.impact(frame(spark, edges), spark.createDataFrame([(r,) for r in [*roots, None]], "root long"), depth, most)
    assert sorted(tuple(r) for r in got.collect()) == brute_impact(edges, sorted(set(roots)), depth, most)


def test_hub_is_dealt_over_blocks_and_few_looks_decide(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 50)
    edges = [(0, i) for i in range(1, 600)] + [(i, 0) for i in range(1, 300)] + [(i, i + 1) for i in range(1, 100)]
    got = graph.impact(frame(spark, edges), spark.createDataFrame([(0,), (5,), (450,)], "root long"), 2, 20)
    assert sorted(tuple(r) for r in got.collect()) == brute_impact(edges, [0, 5, 450], 2, 20)
    a = graph.Adjacency(frame(spark, edges))
    assert a.steps.where("src = 0").select("block").distinct().count() == 12
    assert a.next(spark.createDataFrame([(7, 0)], "root long, node long")).count() == 599


def test_reach_stops_at_enough_and_timeline_is_whole(spark):
    edges = [(0, i) for i in range(1, 9)] + [(i, 100 + i) for i in range(1, 9)] + [(20, 21), (21, 22)]
    roots = spark.createDataFrame([(0,), (20,)], "root long")
    got = {(r.root, r.node): r.depth for r in graph.reach(frame(spark, edges), roots, 2, 5).collect()}
    assert got == {(0, i): 1 for i in range(1, 9)} | {(20, 21): 1, (20, 22): 2}
    assert graph.reach(frame(spark, edges), roots, 2).count() == 18


def test_network_with_its_edges(spark):
    rng = random.Random(4)
    pairs = {(a, b): rng.randrange(1, 9) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.2}
    e = spark.createDataFrame([(*k, w) for k, w in pairs.items()], "a long, b long, weight long")
    ways = [*pairs, *((b, a) for a, b in pairs)]
    for depth in (1, 2):
        nodes = graph.network(e, spark.createDataFrame([(3,), (7,), (77,)], "root long"), depth, 8)
        got, want, inside = sorted(tuple(r) for r in nodes.collect()), [], []
        for r in (3, 7, 77):
            first = sorted((d, n) for n, d in (levels(ways, r, depth) | {r: 0}).items())[:8]
            want += [(r, n, d) for d, n in first]
            keep = {n for _, n in first}
            inside += [(r, a, b, w) for (a, b), w in pairs.items() if a in keep and b in keep]
        assert got == sorted(want)
        assert sorted(tuple(r) for r in graph.network_edges(e, nodes).collect()) == sorted(inside)


def test_impact_looks_move_lists_and_lone_steps_meet_once(spark):
    rng = random.Random(9)
    edges = [(a, b) for a in range(60) for b in range(60) if a != b and rng.random() < 0.3]
    a, roots = graph.Adjacency(frame(spark, edges)), spark.createDataFrame([(r,) for r in range(0, 60, 2)], "root long")
    have = set(edges)
    assert {tuple(r) for r in a.lone(roots).collect()} == {(b, x) for x, b in have if b % 2 == 0 and (b, x) not in have}
    left = {tuple(r) for r in a.unmet(a.first(roots), a.lone(roots)).collect()}
    assert left == {(b, x) for x, b in have if b % 2 == 0 and (b, x) not in have and not any((b, m) in have and (m, x) in have for m in range(60))}
    assert a.lists.count() == len({x for x, _ in have})  # a row a node, not a step
