import json

from mnemo.operators.store import Store
from mnemo.streaming import streams as S

SCHEMA = "atom string, kind string, timestamp timestamp, error string"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"atom": a, "kind": k, "timestamp": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", "error": e}) for a, k, s, e in rows))


def test_attempts_waits_dead_letters_and_stale_claims(spark, tmp_path):
    log, store = tmp_path / "log", Store(spark, str(tmp_path / "s"))

    def go():
        S.work_queue(S.landing(spark, str(log), SCHEMA), store, str(tmp_path / "cp"))
        return {r.atom: r for r in store.read("jobs").collect()}

    land(log, "1.json", [("bad", "enqueue", 0, None), ("ok", "enqueue", 0, None), ("stuck", "enqueue", 0, None), ("ok", "claim", 1, None), ("stuck", "claim", 1, None), ("bad", "claim", 1, None), ("bad", "failed", 2, "x")])
    jobs = go()
    assert (jobs["bad"].status, jobs["bad"].attempts, str(jobs["bad"].next_at)) == ("queued", 1, "2024-01-01 00:00:04")
    assert jobs["ok"].status == jobs["stuck"].status == "in_progress"
    at, rows = 4, [("ok", "done", 3, None)]
    for n in range(2, 7):  # the sixth claim comes too late: the fifth failure gave the job up
        rows += [("bad", "claim", at, None), ("bad", "failed", at + 1, f"x{n}")]
        at = at + 1 + 2**n
    land(log, "2.json", rows)
    jobs = go()
    assert (jobs["bad"].status, jobs["bad"].attempts, jobs["bad"].error) == ("failed", 5, "x5")
    assert jobs["ok"].status == "done" and jobs["stuck"].status == "in_progress"
    assert [r.atom for r in store.read("dead_letters").collect()] == ["bad"]
    land(log, "3.json", [("other", "enqueue", 1000, None)])
    go()
    land(log, "4.json", [("other", "claim", 1001, None)])
    jobs = go()  # the watermark has passed the claim's five minutes
    assert (jobs["stuck"].status, jobs["stuck"].attempts, jobs["stuck"].error, str(jobs["stuck"].next_at)) == ("queued", 1, "stale claim", "2024-01-01 00:05:01")
    assert [r.atom for r in S.claimable(store.read("jobs"), "2024-01-01 00:10:00").collect()] == ["stuck"]


def test_ingest_of_touched_buckets(spark, tmp_path):
    log, store = tmp_path / "in", Store(spark, str(tmp_path / "t"))
    log.mkdir()
    go = lambda: S.ingest_touched(S.landing(spark, str(log), "k int, v string"), store, "t", ["k"], str(tmp_path / "cp"), buckets=16)
    files = []
    for n, rows in enumerate(([(i, "a") for i in range(100)], [(2, "c"), (300, "d")], [(2, "e")])):
        (log / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
        go()
        files.append(store.manifest()["tables"]["t"]["parts"])
    go()
    assert store.manifest()["tables"]["t"]["parts"] == files[2]
    assert sum(files[1][b] != files[2][b] for b in files[2]) == 1
    assert {r.k: r.v for r in store.read("t").collect()} == {i: "a" for i in range(100)} | {2: "e", 300: "d"}
