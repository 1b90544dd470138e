"""Recall makes only the edges, atoms and names that its cues meet."""

import pytest
from pyspark.sql import functions as F

from mnemo.operators import frames, graph, recall, search
from mnemo.operators.vectors import VectorIndex
from mnemo.plans import catalogue, catalogue_indexes  # noqa: F401  the second adds to the first
from mnemo.plans.roles import AS_OF_ORDERS, Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [500_000, 500])
def test_ways_are_the_associations_of_some_nodes(spark, monkeypatch, rows):
    monkeypatch.setattr(frames, "TASK_ROWS", rows)
    t = Tables(spark, SF)
    nodes = t.entities().where("entity % 3 = 0").select("entity")
    want = graph.both_ways(t.assoc()).where("src % 3 = 0")
    got = t.ways(nodes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert rows > 500 or got.rdd.getNumPartitions() >= want.agg(F.sum("weight")).head()[0] // 500
    assert t.ways(nodes.limit(0)).collect() == []


def test_a_few_active_entities_reach_the_lines_before_they_are_grouped(spark):
    t = Tables(spark, SF)
    active = frames.saved(spark.range(5).select(F.col("id").alias("entity")), "active")
    plan = frames.only(t.mentions(), active, "entity")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [atom") < plan.index("Join LeftSemi")


@pytest.mark.parametrize("name", ["associate", "associate_all_ways"])
def test_registered_recall_makes_no_whole_graph_or_index(spark, monkeypatch, name):
    t = Tables(spark, SF)
    e, c, extra = t.entities(), catalogue.cues(t), {}
    atoms = catalogue.scored_atoms(t).withColumn("access_count", F.coalesce("reads", F.lit(0)))
    if name == "associate_all_ways":
        v = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        asked = c.select(F.col("cue").cast("long").alias("id")).join(v, "id").withColumnRenamed("id", "query")
        near = VectorIndex.build(v).search(asked, 5, 0.4).select(F.col("query").alias("cue"), F.col("id").alias("entity"), "similarity")
        index = search.Index.build(e.select(F.lit("entity").alias("label"), F.col("entity").alias("id"), F.col("name").alias("text")))
        extra = {"index": index, "vectors": near, "saturate": True}
    want = recall.associate(c, e, t.assoc(), t.mentions(), atoms, catalogue.at(AS_OF_ORDERS, "timestamp"), **extra).collect()
    for owner, made in ((Tables, "assoc"), (search.Index, "build"), (VectorIndex, "build")):
        monkeypatch.setattr(owner, made, lambda *a: 1 / 0)  # before, all edges were made, all names indexed, all vectors dealt
    got = catalogue.QUERIES[name](spark, SF).collect()
    assert len(got) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))
