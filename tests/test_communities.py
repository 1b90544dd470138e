import random
import zlib

from mnemo.operators import maintain
from mnemo.operators.communities import LEVELS, ROUNDS, communities, modularity


def brute_q(edges, label):
    m2 = 2 * sum(w for _, _, w in edges)
    total, inside = {}, 0
    for a, b, w in edges:
        for x in (a, b):
            total[label[x]] = total.get(label[x], 0) + w
        inside += 2 * w * (label[a] == label[b])
    return inside / m2 - sum(t * t for t in total.values()) / m2**2


def plain(edges, rounds=ROUNDS, levels=LEVELS):
    e = {}
    for a, b, w in edges:
        k = (min(a, b), max(a, b))
        e[k] = e.get(k, 0) + w
    m2 = float(2 * sum(e.values()))
    whole = {x: x for k in e for x in k}
    for _ in range(levels):
        flat = [(a, b, w) for (a, b), w in e.items()]
        nodes = {x for k in e for x in k}
        degree, near = dict.fromkeys(nodes, 0), {x: {} for x in nodes}
        for a, b, w in flat:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[b][a] = w
        label = {x: x for x in nodes}
        best, moved, idle = brute_q(flat, label), False, 0
        for r in range(rounds):
            size = {}
            for x in nodes:
                size[label[x]] = size.get(label[x], 0) + degree[x]
            new = {}
            for x in nodes:
                links = {label[x]: 0.0}
                for y, w in near[x].items():
                    links[label[y]] = links.get(label[y], 0) + w
                top = max((k * m2 - degree[x] * (size[t] - (degree[x] if t == label[x] else 0)), t == label[x], -t) for t, k in links.items())
                turn = (zlib.crc32(f"{x}:{r // 2}".encode()) + r) % 2 == 0
                new[x] = -top[2] if turn else label[x]
            q = brute_q(flat, new)
            if q > best + 1e-9:
                label, best, moved, idle = new, q, True, 0
            else:
                idle += 1
                if idle == 2:
                    break
        if not moved:
            break
        whole = {x: label[t] for x, t in whole.items()}
        e2 = {}
        for a, b, w in flat:
            k = (min(label[a], label[b]), max(label[a], label[b]))
            e2[k] = e2.get(k, 0) + w
        e = e2
    name = {}
    for x, t in whole.items():
        name[t] = min(x, name.get(t, x))
    return {x: name[t] for x, t in whole.items()}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, weight long")


def test_equal_to_the_plain_run_and_not_below_label_votes(spark):
    rng = random.Random(5)
    for n, groups in ((12, 3), (60, 6)):
        edges = [(a, b, rng.randrange(2, 6)) for a in range(n) for b in range(a) if rng.random() < (0.7 if a % groups == b % groups else 0.06)]
        df = frame(spark, edges)
        got = communities(df)
        label = {r.node: r.theme for r in got.collect()}
        assert label == plain(edges)
        votes = maintain.themes(df, 2)
        q = brute_q(edges, label)
        assert abs(q - modularity(df, got)) < 1e-9
        assert q >= brute_q(edges, {r.node: r.theme for r in votes.collect()}) - 1e-9
        assert q > 0.3
        assert maintain.theme_edges(got).count() == sum(x != t for x, t in label.items())


def test_two_cliques_and_nothing(spark):
    edges = [(a, b, 1) for k in (0, 10) for a in range(k, k + 5) for b in range(k, a)] + [(0, 10, 1)]
    assert {r.node: r.theme for r in communities(frame(spark, edges)).collect()} == {x: x - x % 10 for k in (0, 10) for x in range(k, k + 5)}
    assert communities(frame(spark, [])).collect() == []
    assert {r.node: r.theme for r in communities(frame(spark, [(4, 4, 3), (7, 4, 1), (None, 7, 1)])).collect()}.keys() == {4, 7}


def test_weak_edges_of_pairs_named_once_are_not_grouped(spark, monkeypatch):
    from mnemo.plans import catalogue, catalogue_graphs

    edges = frame(spark, [(1, 2, 1), (2, 1, 1), (3, 4, 2)])
    assert {r.node for r in communities(edges, 2).collect()} == {1, 2, 3, 4}
    assert {r.node for r in communities(edges, 2, once=True).collect()} == {3, 4}  # left out before sums are made
    told = []
    monkeypatch.setattr(catalogue_graphs, "communities", lambda edges, least, **how: told.append(how) or edges)
    pairs = catalogue.QUERIES["theme_communities"](spark, "/root/testdata/sf0.001")
    assert told == [{"once": True}] and pairs.where("a >= b").count() == 0 and pairs.groupBy("a", "b").count().where("count > 1").count() == 0
