"""Communities of a weighted graph by modularity: parallel moves, then coarsening, until nothing grows.

In a round every node weighs the communities of its neighbours by the gain in modularity and half of the
nodes, chosen by a hash of node and round, move to the best; so two neighbours do not swap places for ever.
When no half gains any more, communities become the nodes of a smaller graph and moves start again. Only
sums come to the driver: the total weight, once, and the modularity after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.operators.frames import saved

ROUNDS, LEVELS = 8, 4


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of undirected edges (a, b, weight), loops allowed, under labels (node, theme)."""
    named = labels.select("node", "theme")
    at = edges.join(named.toDF("a", "ta"), "a").join(named.toDF("b", "tb"), "b")
    ends = at.select(F.explode(F.array(F.struct(F.col("ta").alias("t")), F.struct(F.col("tb").alias("t")))).alias("e"), "weight", (F.col("ta") == F.col("tb")).alias("inside"))
    sums = ends.groupBy("e.t").agg(F.sum("weight").cast("double").alias("all"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0)).cast("double").alias("inside"))
    x = sums.agg(F.sum("all").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("all") * F.col("all")).alias("squares")).head()
    return x.inside / x.m2 - x.squares / x.m2**2 if x.m2 else 0.0


def _level(edges: DataFrame, m2: float, rounds: int) -> tuple[DataFrame, bool]:
    """Labels (node, theme) after moves on one level, and whether anything moved for good."""
    loop = F.col("a") == F.col("b")
    ways = saved(edges.where(~loop).select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "weight").select("e.*", F.col("weight").cast("double").alias("weight")), "ways")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("weight").cast("double").alias("w"))
    degree = saved(ends.groupBy("node").agg(F.sum("w").alias("degree")), "degrees")
    now = degree.select("node", F.col("node").alias("theme"), "degree")
    best, moved, idle = modularity(edges, now), False, 0
    for r in range(rounds):
        size = now.groupBy("theme").agg(F.sum("degree").alias("size"))
        link = ways.join(now.select(F.col("node").alias("dst"), "theme"), "dst").groupBy(F.col("src").alias("node"), "theme").agg(F.sum("weight").alias("links"))
        own = now.select("node", F.col("theme").alias("own"), "degree")
        cand = link.unionByName(now.select("node", "theme", F.lit(0.0).alias("links"))).groupBy("node", "theme").agg(F.sum("links").alias("links"))
        cand = cand.join(size, "theme").join(own, "node")
        rest = F.col("size") - F.when(F.col("theme") == F.col("own"), F.col("degree")).otherwise(0.0)
        gain = F.col("links") * m2 - F.col("degree") * rest
        to = cand.withColumn("gain", gain).groupBy("node").agg(F.max(F.struct("gain", (F.col("theme") == F.col("own")).alias("stay"), (-F.col("theme")).alias("low"), "theme")).alias("x"), F.first("own").alias("own"), F.first("degree").alias("degree"))
        turn = F.pmod(F.crc32(F.concat_ws(":", "node", F.lit(r // 2)).cast("binary")) + r, F.lit(2)) == 0
        new = saved(to.select("node", F.when(turn, F.col("x.theme")).otherwise(F.col("own")).alias("theme"), "degree"), "moves")
        q = modularity(edges, new)
        if q > best + 1e-9:
            now, best, moved, idle = new, q, True, 0
        else:
            idle += 1
            if idle == 2:  # neither half gains
                break
    return now.select("node", "theme"), moved


def communities(edges: DataFrame, least_weight: int = 1, rounds: int = ROUNDS, levels: int = LEVELS, once: bool = False) -> DataFrame:
    """(node, theme) of undirected edges (a, b, weight) with whole-number nodes; a theme is named by its least node.

    Weights are summed for repeated edges; edges under least_weight and nulls are left out; ties go to the
    own community, then to the least. A round shuffles edges by node; state is in tables. once: no pair is repeated,
    either way round, so weak edges are left out before edges are shuffled and grouped, which hardly combines them."""
    edges = edges.where(F.col("weight") >= least_weight) if once else edges
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    e = saved(edges.where("a is not null and b is not null").groupBy(low, high).agg(F.sum("weight").alias("weight")).where(F.col("weight") >= least_weight), "edges")
    m2 = float(2 * (e.agg(F.sum("weight")).head()[0] or 0))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = saved(nodes.select("node", F.col("node").alias("theme")), "themes")
    for _ in range(levels if m2 else 0):
        labels, moved = _level(e, m2, rounds)
        if not moved:
            break
        whole = saved(whole.join(labels.toDF("theme", "to"), "theme").select("node", F.col("to").alias("theme")), "themes")
        at = e.join(labels.toDF("a", "ta"), "a").join(labels.toDF("b", "tb"), "b")
        e = saved(at.groupBy(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.sum("weight").alias("weight")), "edges")
    least = whole.groupBy("theme").agg(F.min("node").alias("name"))
    return whole.join(least, "theme").select("node", F.col("name").alias("theme"))
