"""Cues whose names many entities bear."""

from mnemo.operators import search


def test_equal_names_are_cut_before_they_meet_cues(spark):
    n = 400
    e = spark.createDataFrame([(i, ("Hot ring", "hot bolt", "cold ring", None)[i % 4]) for i in range(n)], "entity long, name string")
    c = spark.createDataFrame([(1, "hot ring"), (2, "Ring"), (3, "x hot")], "cue int, text string")
    got = sorted(tuple(r) for r in search.seeds(e, c, 3).collect())
    assert got == [(1, 0, 1.0), (1, 4, 1.0), (1, 8, 1.0), (2, 0, 0.7), (2, 2, 0.7), (2, 4, 0.7), (3, 0, 0.6), (3, 1, 0.6), (3, 4, 0.6)]
    plan = search.seeds(e, c, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") > 1  # entities of a name are ranked below the join, not only the result
