"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading: tasks note every place where a record could begin, with the place where its successor would
begin by its Content-Length. Only places on the chain from the start of the file are records; pointer
jumping finds them in a logarithmic number of joins, so the magic inside a payload is rejected without
any task walking a file from its start.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm.common import saved

MAGIC, GAP = re.compile(rb"WARC/1\.\d\r\n"), "\r\n\r\n"
#: Payloads from this size on are stored once.
LEAST_REVISIT = 1000
RECORDS_A_FILE = 1000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def with_decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), bytes, digest, refers_to: the page that holds an equal payload.

    Of equal payloads of LEAST_REVISIT bytes or more the largest page_id keeps it. Digests are counted
    before they are joined, so a payload that many pages share is no large group.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    shared = base.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "first_id")
    joined = base.join(shared, ["digest", "bytes"], "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "bytes", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, path: str) -> None:
    """One record a page: response with the payload, or revisit without. Spark's text writer commits the
    files (gzip), with the record separator as its line end."""
    p = with_decisions(pages)
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), "html"))
    fields = [
        F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *fields), F.lit(GAP), block)
    p.select(record.alias("value")).write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


CANDIDATES = "file long, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_ID = re.compile(r"<urn:page:(-?\d+)>")


def header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header at a place and where its block starts; None if it is no header."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    lines = data[at:end].split(b"\r\n")[1:]
    if not all(b":" in x for x in lines):
        return None
    pairs = (x.decode("utf-8", "replace").split(":", 1) for x in lines)
    return {k.strip().lower(): v.strip() for k, v in pairs}, end + 4


def candidates(name: int, data: bytes, path: str = "") -> list[tuple]:
    """Every place with the magic and a header with a length that ends in the file, and the end of the file
    (record type "end", with its path), which the chain of a whole file reaches."""
    out = [(name, len(data), -1, None, None, "", "end", None, path)]
    for m in MAGIC.finditer(data):
        at = m.start()
        found = header(data, at)
        if found and found[0].get("content-length", "").isdigit():
            h, start = found
            stop = start + int(h["content-length"])
            if stop <= len(data):
                number = lambda k: int(m[1]) if (m := _ID.search(h.get(k, ""))) else None
                kind = h.get("warc-type", "")
                if kind == "revisit":
                    n, digest = h.get("warc-payload-length", ""), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    n = int(n) if n.isdigit() else None
                else:
                    head = data.find(b"\r\n\r\n", start, stop)
                    payload = data[head + 4 if head >= 0 else start : stop]
                    n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                out.append((name, at, stop + 4, number("warc-record-id"), n, digest, kind, number("warc-refers-to"), h.get("warc-target-uri", "")))
    return out


def unpacked(content: bytes) -> bytes:
    """The bytes of a file: gzip files are read member by member, as most archives have one a record."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out += [d.decompress(content), d.flush()]
        content = d.unused_data
    return b"".join(out)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    for f in frames:
        for name, path, content in zip(f["file"], f["path"], f["content"], strict=True):
            out = pd.DataFrame(candidates(name, unpacked(bytes(content)), path), columns=names)
            yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def reachable(links: DataFrame) -> DataFrame:
    """Of links (file, at, next), the places (file, at) on the chain from place 0 of each file.

    Round k knows the first 2**k records and, of every place, the place 2**k records on.
    """
    jump = saved(links.select("file", "at", "next"), "jump")
    known, n = jump.where("at = 0").select("file", "at"), -1
    while True:
        ahead = known.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = saved(known.union(ahead.join(links.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "known")
        now = grown.count()
        if now == n:
            return grown
        known, n = grown, now
        jump = saved(jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("far")), ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jump")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url: the records of the archives in a folder.

    Payload facts of responses are taken from the payload bytes, those of revisits from their header. A page_id
    is null where the record's id is not one of this library's. Raises ValueError if the chain of a file
    breaks off before its end: the records after a damaged one cannot be told from payloads. A file is read
    by one task, so files should be small, as those of write() are.
    """
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "path", "content")
    found = saved(files.mapInPandas(_scan, CANDIDATES), "candidates")
    records = saved(found.join(reachable(found), ["file", "at"]), "records")
    broken = found.where("record_type = 'end'").join(records.where("record_type = 'end'").select("file"), "file", "left_anti").limit(5).collect()
    if broken:
        raise ValueError(f"damaged archives: {', '.join(r['url'] for r in broken)}")
    return records.where("record_type <> 'end'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top = page_id THEN NULL ELSE top END AS refers_to FROM g"""
