import io
import json
import random

from mnemo.streaming import tail as T


def run(df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / name))


def test_each_line_of_open_files_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text("one\ntwo\nthr")
    got = lambda: sorted((r.file, r.at, r.line) for r in run(T.tail(spark, str(log)), tmp_path, "out").collect())
    assert got() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    with (log / "a.jsonl").open("a") as f:
        f.write("ee\n\nfour")
    (log / "b.jsonl").write_text("é\r\n")
    want = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "three"), ("a.jsonl", 14, ""), ("b.jsonl", 0, "é")]
    assert got() == want
    assert got() == want  # nothing new
    with (log / "a.jsonl").open("a") as f:
        f.write("\n")
    assert got() == sorted([*want, ("a.jsonl", 15, "four")])


def test_ranges_cut_anywhere_give_each_line_once():
    rng = random.Random(1)
    for _ in range(300):
        data = b"".join(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) + b"\n" for _ in range(rng.randrange(0, 12)))
        f = io.BytesIO(data + b"unfinished")
        end = T.whole_lines(f, 0, len(data) + 10)
        assert end == len(data)
        cuts = sorted({0, end, *(rng.randrange(0, end + 1) for _ in range(3))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in T.lines_of(f, T.Range("f", a, b, 0, end))]
        assert [line for _, line in got] == data.split(b"\n")[:-1]
        assert all(data[at : at + len(line)] == line for at, line in got)


def test_envelopes_and_other_lines(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    good = {"id": "1", "kind": "k", "source": "s", "timestamp": "2024-01-01T00:00:00Z", "data": "{}"}
    (log / "x").write_text(json.dumps(good) + "\n{broken\n\n")
    events, other = T.tail_events(spark, str(log))
    assert [r.id for r in run(events, tmp_path, "good").collect()] == ["1"]
    assert [(r.at, r.line) for r in run(other, tmp_path, "bad").collect()] == [(len(json.dumps(good)) + 1, "{broken")]
