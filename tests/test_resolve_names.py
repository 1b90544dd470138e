"""Many mentions and entities of one name and type."""

from pyspark.sql import functions as F

from mnemo.operators import resolve


def rows_of(plan: str) -> list[str]:
    return [x for x in plan.splitlines() if "Join" in x]


def test_a_name_of_many_entities_meets_each_mention_once(spark, tmp_path):
    n = 1500
    names = spark.range(n).select(F.col("id").alias("mention"), F.lit("hot ring").alias("name"), F.lit("SMALL").alias("type"))
    entities = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("hot ring").alias("name"), F.lit("SMALL").alias("type"))
    schema = "mention long, name string, type string, entity string, entity_name string, entity_type string, last_seen timestamp, overlap double, place int"
    out = resolve.resolve(names, entities, spark.createDataFrame([], schema), F.lit("2001-01-01").cast("timestamp_ntz"))
    assert [tuple(r) for r in out.select("entity", "decision").distinct().collect()] == [("0", "exact")] and out.count() == n
    exact = out.where("decision = 'exact'")
    exact.write.format("noop").mode("overwrite").save()
    joined = exact._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("Join") < joined.rindex("Aggregate")  # entities are aggregated below the join


def test_two_names_are_compared_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def alike(a, b):
        def one(x, y):
            seen.add(1)
            return 1.0 if x == y else 0.25

        return F.udf(one, "double")(a, b)

    monkeypatch.setattr(resolve.T, "name_similarity", alike)
    rows = [(i, ["hot ring", "red bolt", None][i % 3], "SMALL", str(j), ["hot ring", "red bolt"][j % 2], "SMALL", None, 0.5, 1) for i in range(30) for j in range(6)]
    pairs = spark.createDataFrame(rows, "mention long, name string, type string, entity string, entity_name string, entity_type string, last_seen timestamp, overlap double, place int")
    out = resolve.fit(pairs, resolve.GENERAL, F.lit("2001-01-01").cast("timestamp_ntz"))
    assert out.columns == [*pairs.columns, "fit"] and out.count() == 180 and out.groupBy("mention").count().count() == 30
    assert out.where("name = entity_name").agg(F.min("fit")).head()[0] > out.where("name <> entity_name").agg(F.max("fit")).head()[0]
    assert seen.value == 6  # before: once for each of 180 pairs


def test_candidates_are_dealt_by_mention(spark, monkeypatch):
    from mnemo.operators import frames

    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    names = spark.range(200).select(F.col("id").alias("mention"), F.lit("hot ring").alias("name"))
    entities = spark.range(50).select(F.col("id").alias("entity"), F.lit("hot ring").alias("name"))
    out = resolve.candidates(names, entities, n=10)
    assert out.rdd.getNumPartitions() >= 20 and out.count() == 2000
