import zlib

from mnemo.llm import sharding as s


def test_few_rows_move_and_slots_are_gapless(spark):
    rows = [(i, None if i % 50 == 0 else f"tëxt {i % 7}", "z") for i in range(2000)] + [(None, "a", "z"), (5, "tëxt 5", "z"), (5, "tëxt 5", "z")]
    out = s.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert len(out) == len(rows)
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
        assert 150 < sum(r.shard == k for r in out) < 360
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    assert 100 < sum(r.grown_shard == 8 for r in out) < 350
    texts = {i: (t or "").encode() for i, t, _ in rows}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in out)
    assert s.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights(spark):
    out = s.assign(spark.range(4000), "id", {0: 1.0, 1: 3.0, 2: 0.0}).groupBy("shard").count().collect()
    n = {r["shard"]: r["count"] for r in out}
    assert set(n) == {0, 1} and 2.5 < n[1] / n[0] < 3.6
