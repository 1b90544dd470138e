from mnemo.operators import recall


def test_no_instance_is_lost(spark):
    rows = [(f"i{i}", "active", "billing service" if i < 60 else "graph store") for i in range(1100)] + [("off", "paused", "billing")]
    instances = spark.createDataFrame(rows, "name string, status string, description string")
    queries = spark.createDataFrame([("q1", "billing"), ("q2", "nothing alike"), ("q3", "")], "query string, text string")
    got = [tuple(r) for r in recall.children_for(queries, instances).collect()]
    every = {n for n, status, _ in rows if status == "active"}
    assert len(got) == len(set(got))
    assert set(got) == {("q1", f"i{i}") for i in range(60)} | {(q, n) for q in ("q2", "q3") for n in every}
