import pytest
from pyspark.sql import functions as F

from mnemo.operators.store import Conflict, Store


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, created_at long")


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = [(i, f"a{i}", 1) for i in range(200)]
    assert store.upsert("notes", frame(spark, first), ["id"], batch=0, buckets=16) == 1
    before = store.manifest()
    store.upsert("notes", frame(spark, [(3, "new", 9), (500, "b", 9)]), ["id"], batch=1)
    after = store.manifest()
    moved = [b for b in after["tables"]["notes"]["parts"] if after["tables"]["notes"]["parts"][b] != before["tables"]["notes"]["parts"].get(b)]
    assert 1 <= len(moved) <= 2
    want = sorted([(i, t, c) for i, t, c in first if i != 3] + [(3, "new", 1), (500, "b", 9)])
    assert rows_of(store.read("notes").select("id", "text", "created_at")) == want
    assert rows_of(store.read("notes", before).select("id", "text", "created_at")) == sorted(first)  # a pinned reader
    assert store.upsert("notes", frame(spark, [(3, "again", 9)]), ["id"], batch=1) is None
    assert store.manifest() == after
    store.upsert("notes", frame(spark, []), ["id"], batch=2)
    assert rows_of(store.read("notes").select("id", "text", "created_at")) == want
    assert store.clear(keep=1) == [] or rows_of(store.read("notes").select("id", "text", "created_at")) == want


def test_old_folders_are_cleared(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for n in range(4):
        store.upsert("notes", frame(spark, [(i, f"v{n}", n) for i in range(20)]), ["id"], batch=n, buckets=4)
    assert len(store.clear(keep=1)) == 3 and store.versions() == [4]
    assert rows_of(store.read("notes").select("text").distinct()) == [("v3",)]


def test_two_writers_of_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append({"a": spark.range(3)})
    late = store.manifest()
    store.append({"a": spark.range(3)})
    with pytest.raises(Conflict):
        store.publish(late)
    assert store.read("a").count() == 6


def test_several_tables_or_none(spark, tmp_path):
    from mnemo.operators import sinks

    store = Store(spark, str(tmp_path / "s"))
    new = spark.createDataFrame([("x", "note", "high", "e1", None, "i", "/w"), ("y", "note", "low", None, "p1", "i", "/w")], "content string, kind string, salience string, episode string, supersedes string, instance string, cwd string")
    as_of = F.lit("2024-01-01").cast("timestamp")
    assert sinks.publish_atoms(store, new, as_of, batch="b1") == 1
    old = {n: rows_of(store.read(n)) for n in ("atoms", "in_episode", "supersedes", "jobs")}
    assert [len(old[n]) for n in ("atoms", "in_episode", "supersedes", "jobs")] == [2, 1, 1, 2]
    calls = []

    def failing(df):
        calls.append(1)
        if len(calls) > 2:
            raise OSError("disk is full")
        return store.stage(df)

    with pytest.raises(OSError):
        sinks.publish_atoms(store, new.withColumn("content", F.lit("z")), as_of, batch="b2", stage=failing)
    assert {n: rows_of(store.read(n)) for n in old} == old and len(calls) == 3
    assert sinks.publish_atoms(store, new, as_of, batch="b1") is None  # the same batch again
    assert len(store.clear(keep=1)) == 2  # what the failed write had staged
    assert {n: rows_of(store.read(n)) for n in old} == old
