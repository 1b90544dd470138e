import random

from mnemo.functions import text as T
from mnemo.operators import resolve, search
from mnemo.operators.vectors import VectorIndex
from pyspark.sql import functions as F


def test_parts_of_names_equal_brute_force(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abÄ c") for _ in range(rng.randrange(0, 9))) for _ in range(200)] + [None, "İstanbul", "aaaa"]
    entities = spark.createDataFrame(list(enumerate(names)), "entity long, name string")
    cues = [(i, "".join(rng.choice("ABä c") for _ in range(rng.randrange(0, 5)))) for i in range(60)] + [(60, None), (61, "zz"), (62, "aaa"), (62, "AB"), (62, "ab")]
    c = spark.createDataFrame(cues, "cue long, text string")
    got = sorted(tuple(r) for r in search.by_partial_name(entities, c).collect())
    want = sorted((q, i) for q, t in cues if t is not None and len(t) >= 2 for i, n in enumerate(names) if n is not None and t.lower() in n.lower() and n != "İstanbul")
    assert got == want
    plan = search.by_partial_name(entities, c)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_from_four_indexes(spark):
    rows = [(1, "Brainy", None, 5, [1.0, 0.0]), (2, "brainy", None, 9, None), (3, "Other tool", ["Brain"], 1, [0.6, 0.8]), (4, "brainy notes", [], 2, None)] + [(100 + i, "Hot", None, i, None) for i in range(50)]
    e = spark.createDataFrame(rows, "entity long, name string, aliases array<string>, last_seen long, vector array<float>")
    names = spark.createDataFrame([(1, "BRAINY", "tool", [0.0, 1.0]), (2, "brain", "x", None), (3, None, "x", None), (4, "hot", "y", None), (5, "hot", "z", [1.0, 0.0]), (6, "unknown", "z", None)], "mention long, name string, type string, vector array<float>")
    index = search.Index.build(e.select(F.lit("e").alias("label"), F.col("entity").alias("id"), F.col("name").alias("text")))
    vectors = VectorIndex.build(e.select(F.col("entity").alias("id"), "vector"))
    got = {}
    for r in resolve.candidates(names, e, index, vectors, names.select("mention", "vector"), n=5).collect():
        got.setdefault(r.mention, {})[r.entity] = round(r.weight, 6)
    assert set(got) == {1, 2, 4, 5}
    assert got[1][1] == got[1][2] == 1.0 and got[1][3] == 0.8 and 0 < got[1][4] <= 0.8
    assert got[2] == {3: 0.9}
    assert got[4] == {149 - i: 1.0 for i in range(5)}  # the last seen of many
    assert got[5][1] == 1.0 and len(got[5]) == 5


def test_ids_sort_by_time_and_repeat(spark):
    df = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}") for i in range(20)], "k int, at string").select("k", T.ulid(F.col("at").cast("timestamp"), F.col("k").cast("string")).alias("id"), T.is_ulid(T.ulid(F.col("at").cast("timestamp"), F.col("k").cast("string"))).alias("ok"))
    rows = df.orderBy("id").collect()
    assert [r.k for r in rows] == list(range(20)) and all(r.ok and len(r.id) == 26 for r in rows) and df.collect() == df.collect()
    assert rows[0].id.startswith("01HK153X00")
