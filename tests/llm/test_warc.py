import gzip
import hashlib

import pytest

from mnemo.llm import warc as w
from mnemo.llm.common import scratch_path


def read_back(spark, rows, schema="page_id long, url string, html string"):
    path = scratch_path(spark, "t")
    w.write(spark.createDataFrame(rows, schema), path)
    return w.read(spark, path)


def test_round_trip_with_hostile_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é" * 600
    rows = [(1, "http://a", "x" + fake + "y"), (2, "u\r\nContent-Length: 9", fake), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "s"), (8, "u", "s"), (9, "u", "WARC/1.0\r\n" * 300), (10, "u", "q" * 999), (11, "u", "q" * 999), (None, "u", big)]
    got = {r.page_id: r for r in read_back(spark, rows).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[i].record_type == ("revisit" if i in (5, None) else "response")
        assert got[i].refers_to == (6 if i in (5, None) else None)


def test_repeated_rows_extra_columns_and_empty(spark):
    rows = [(1, "u", "z" * 2000, "x"), (1, "u", "z" * 2000, "x")]
    out = read_back(spark, rows, "page_id long, url string, html string, digest string").collect()
    assert [(r.page_id, r.record_type) for r in out] == [(1, "response")] * 2
    assert read_back(spark, []).count() == 0


def test_only_the_chain_counts(spark):
    a = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    inner = b"WARC/1.0\r\nContent-Length: " + str(len(a)).encode() + b"\r\n\r\n" + a + b"\r\n\r\n"
    found = w.candidates(1, inner + a)
    assert len(found) == 4
    links = spark.createDataFrame([(f, at, nxt) for f, at, nxt, *_ in found], "file long, at long, next long")
    assert sorted(r.at for r in w.reachable(links).collect()) == [0, len(inner), len(inner + a)]
    many = spark.createDataFrame([("g", i, i + 1) for i in range(100)] + [("g", 200, 5)], "file string, at long, next long")
    assert w.reachable(many).count() == 100


def test_files_are_archives(spark, tmp_path):
    out = str(tmp_path / "w")
    w.write(spark.createDataFrame([(1, "http://a", "<p>")], "page_id long, url string, html string"), out)
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("part-*"))
    assert w.MAGIC.match(data) and data.endswith(b"<p>\r\n\r\n")


def test_other_archives(spark, tmp_path):
    """A member a record, other names, other versions and ids; a damaged record is an error."""
    record = lambda i, body, version=b"1.1": b"WARC/" + version + b"\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body + b"\r\n\r\n"
    whole = [record(i, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * i, b"1.0" if i % 2 else b"1.1") for i in range(50)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "crawl.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    (tmp_path / "in" / "plain.warc").write_bytes(record(70, b"abc").replace(b"urn:page:70", b"urn:uuid:7") + record(71, b"\r\n\r\nz"))
    (tmp_path / "in" / "empty.warc").write_bytes(b"")
    got = w.read(spark, str(tmp_path / "in")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got if r.page_id is not None) == [*((i, i) for i in range(50)), (71, 1)]
    assert [r.payload_bytes for r in got if r.page_id is None] == [3]
    (tmp_path / "in" / "cut.warc.gz").write_bytes(gzip.compress(b"".join([*whole[:9], whole[9][:-9], *whole[10:]])))
    with pytest.raises(ValueError, match=r"cut\.warc"):
        w.read(spark, str(tmp_path / "in"))
