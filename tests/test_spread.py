"""A spread goes on only from what may still enter a cue's cut."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from mnemo.operators import graph


def brute(edges, seeds, hops, k):
    """The rule without any cut on the way: every node reached in a hop goes on in the next."""
    near, score = {}, {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    for c, e, x in seeds:
        score[c, e] = max(score.get((c, e), x), x)
    front = dict(score)
    for h in range(1, hops + 1):
        reached = {}
        for (c, e), x in front.items():
            for o, w in near.get(e, ()):
                g = float(Decimal(repr(x * (w / (w + 3.0)) * 0.5**h)).quantize(Decimal("1e-9"), ROUND_HALF_UP))  # as Spark rounds
                reached[c, o] = max(reached.get((c, o), g), g)
        for key, g in reached.items():
            score[key] = max(score.get(key, g), g)
        front = {key: score[key] for key in reached}
    out = []
    for c in {c for c, _ in score}:
        out += sorted(((-x, e, c) for (d, e), x in score.items() if d == c))[:k]
    return sorted((c, e, round(-x, 9)) for x, e, c in out)


@pytest.mark.parametrize("k,least", [(3, 1.0), (12, 0.2), (60, 0.01), (5, -0.5)])
def test_spread_equals_the_rule_without_cuts(spark, k, least):
    rng = random.Random(k)
    edges = [(a, b, rng.randrange(1, 9)) for a in range(50) for b in range(a + 1, 50) if rng.random() < 0.12]
    seeds = [(c, rng.randrange(50), rng.choice([least, 1.0, 0.6])) for c in range(6) for _ in range(1 + 3 * c)]
    got = graph.spread_activation(spark.createDataFrame(edges, "a long, b long, weight long"), spark.createDataFrame(seeds, "cue long, entity long, activation double"), 2, 0.5, k)
    assert sorted((r.cue, r.entity, round(r.activation, 9)) for r in got.collect()) == brute(edges, seeds, 2, k)


def test_edges_are_not_made_if_seeds_fill_every_cut(spark):
    edges = spark.range(9).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.raise_error(F.lit("edges were read")).cast("long").alias("weight"))
    seeds = spark.range(20).select((F.col("id") % 2).alias("cue"), F.col("id").alias("entity"), F.lit(1.0).alias("activation"))
    got = graph.spread_activation(edges, seeds, 2, 0.5, 4)
    assert sorted((r.cue, r.entity) for r in got.collect()) == [(0, 0), (0, 2), (0, 4), (0, 6), (1, 1), (1, 3), (1, 5), (1, 7)]


@pytest.mark.parametrize("k,least", [(3, 1.0), (12, 0.2), (60, 0.01)])
def test_a_function_is_asked_for_the_ways_of_what_goes_on(spark, k, least):
    rng = random.Random(100 + k)
    edges = [(a, b, rng.randrange(1, 9)) for a in range(50) for b in range(a + 1, 50) if rng.random() < 0.12]
    seeds = [(c, rng.randrange(50), rng.choice([least, 1.0, 0.6])) for c in range(3) for _ in range(1 + 3 * c)]
    ways, asked = graph.both_ways(spark.createDataFrame(edges, "a long, b long, weight long")), []

    def of(nodes):
        asked.append({r.entity for r in nodes.collect()})
        return ways.join(nodes.withColumnRenamed("entity", "src"), "src", "left_semi")

    got = graph.spread_activation(of, spark.createDataFrame(seeds, "cue long, entity long, activation double"), 2, 0.5, k)
    assert sorted((r.cue, r.entity, round(r.activation, 9)) for r in got.collect()) == brute(edges, seeds, 2, k)
    assert asked[0] <= {e for _, e, _ in seeds}
