import json

from pyspark.sql import functions as F

from mnemo.sources.readers import replay
from mnemo.streaming import streams as S


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def env(i, kind, sec, source="a", reply=None):
    return {"id": f"{i:04d}", "kind": kind, "source": source, "timestamp": f"2024-01-01T00:{sec // 60:02d}:{sec % 60:02d}Z", "data": "{}", "replyTo": reply}


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_replay_and_subscribe(spark, tmp_path):
    land(tmp_path / "log", "1.json", [env(2, "x", 5), env(1, "y", 1), env(3, "x", 9, "b")])
    log = str(tmp_path / "log")
    assert [r.id for r in replay(spark, log, "2024-01-01 00:00:03", ["x"]).collect()] == ["0002", "0003"]
    out = run(S.once(S.subscribe(S.event_log(spark, log), ["x"], None, "b")), tmp_path, "subs")
    assert [r.id for r in out.collect()] == ["0002"]


def test_ingest_twice_is_once(spark, tmp_path):
    land(tmp_path / "in", "1.json", [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}])
    go = lambda: S.ingest(S.landing(spark, str(tmp_path / "in"), "k int, v string"), str(tmp_path / "t"), ["k"], str(tmp_path / "cp"))
    go()
    go()
    land(tmp_path / "in", "2.json", [{"k": 2, "v": "c"}, {"k": 3, "v": "d"}])
    go()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_correlation_batch_and_stream(spark, tmp_path):
    q = [env(1, "q", 0), env(2, "q", 1), env(9, "q", 600)]
    r = [env(3, "r", 3, "c1", "0001"), env(4, "r", 4, "c2", "0001"), env(5, "r", 9, "c1", "0002"), env(10, "r", 601, "c", "zzz")]
    land(tmp_path / "q", "1.json", q)
    land(tmp_path / "r", "1.json", r)
    want = {("0001", "0003"), ("0001", "0004"), ("0002", None)}
    b = S.correlate(replay(spark, str(tmp_path / "q")), replay(spark, str(tmp_path / "r")))
    assert {(x.request, x.reply) for x in b.collect()} - {("0009", None)} == want
    land(tmp_path / "q", "2.json", [env(11, "q", 1200)])
    land(tmp_path / "r", "2.json", [env(12, "r", 1200, "c", "zzz")])
    s = S.correlate(S.landing(spark, str(tmp_path / "q"), S.ENVELOPE, 1), S.landing(spark, str(tmp_path / "r"), S.ENVELOPE, 1))
    assert want <= {(x.request, x.reply) for x in run(s, tmp_path, "corr").collect()}


def test_rates_and_sessions(spark, tmp_path):
    land(tmp_path / "log", "1.json", [env(1, "x", 5), env(2, "x", 50), env(3, "x", 70), env(4, "end", 3000)])
    out = run(S.rates(S.event_log(spark, str(tmp_path / "log")), "1 minute", None, "1 minute"), tmp_path, "rates")
    assert sorted((str(r.start)[-8:], r.n) for r in out.where("kind = 'x'").collect()) == [("00:00:00", 2), ("00:01:00", 1)]
    x = S.event_log(spark, str(tmp_path / "log")).withColumn("instance", F.lit("i")).withColumn("cwd", F.lit("c"))
    got = run(S.session_episodes(x, "5 minutes", "1 minute"), tmp_path, "sess")
    assert [r.messages for r in got.where("messages = 3").collect()] == [3]


def test_episodes_stream_equals_batch(spark, tmp_path):
    rows = [{"instance": "i", "cwd": c, "kind": k, "timestamp": f"2024-01-01T00:00:{s:02d}Z"} for c, k, s in [("a", "m", 1), ("a", "m", 2), ("a", "close", 3), ("a", "m", 4), ("b", "m", 1), ("b", "close", 9)]]
    land(tmp_path / "e", "1.json", rows)
    schema = "instance string, cwd string, kind string, timestamp timestamp"
    got = run(S.open_close_episodes(S.landing(spark, str(tmp_path / "e"), schema)), tmp_path, "epi", "update")
    key = lambda r: (r.cwd, r.number, r.messages, r.closed)
    want = S.batch_episodes(spark.read.schema(schema).json(str(tmp_path / "e")))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) == [("a", 0, 2, True), ("a", 1, 1, False), ("b", 0, 1, True)]


def test_cascade(spark, tmp_path):
    b = spark.createDataFrame([("x", "e1")], "atom string, episode string")
    S.cascade(b, str(tmp_path / "own"), str(tmp_path / "up"), "child")
    up = spark.read.parquet(str(tmp_path / "up")).first()
    assert up.episode is None and up.foreign_episode.episode_id == "e1" and spark.read.parquet(str(tmp_path / "own")).first().episode == "e1"
