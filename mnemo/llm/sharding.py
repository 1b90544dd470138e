"""Sharding: rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the key's md5 that cut a shard into chunks, so that no task numbers a whole shard.
CHUNK_DIGITS = 3


def score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u) with u in (0, 1) from the first 52 bits of md5("key#shard"): the shard with the
    highest score wins, and a shard wins a share of keys in proportion to its weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.lit(float(weight)) / F.log((bits + F.lit(0.5)) / F.lit(float(2**52)))


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key. Adding a shard moves only the keys that the new shard wins; equal scores go
    to the larger shard number. A null key counts as the empty string."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    best = F.greatest(*[F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in weights.items() if w > 0]) if len(weights) > 1 else None
    return best["shard"] if best is not None else F.lit(next(iter(weights)))


def assign(df: DataFrame, key: str, weights: dict[int, float], shard: str = "shard") -> DataFrame:
    return df.withColumn(shard, rendezvous(F.col(key), weights))


def slots(df: DataFrame, key: str, shard: str = "shard", order: list[str] | None = None, slot: str = "slot") -> DataFrame:
    """Number the rows of each shard without gaps from 0, by (md5 chunk of the key, key, order).

    Rows are numbered inside (shard, chunk) and shifted by the counts of earlier chunks: tasks get
    bounded shares of a shard, and only 16**CHUNK_DIGITS counts a shard meet in a window.
    Repeated rows get a slot each.
    """
    chunked = df.withColumn("_chunk", F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, CHUNK_DIGITS))
    counts = chunked.groupBy(shard, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_chunk").orderBy(F.col(key).asc_nulls_first(), *(order or []))
    numbered = chunked.withColumn("_row", F.row_number().over(within))
    return numbered.join(starts, [shard, "_chunk"]).withColumn(slot, F.col("_start") + F.col("_row") - 1).drop("_chunk", "_start", "_row")


def shard_documents(docs: DataFrame, n: int = 8) -> DataFrame:
    """Documents over n equal shards by the law `key`: doc_id and the shard count decide.

    Null texts have size 1 and crc32 0, null ids hash as the empty string, repeated rows stay
    repeated, an empty table gives no rows, other columns of the input are not carried.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    both = assign(assign(base, "doc_id", dict.fromkeys(range(n), 1.0)), "doc_id", dict.fromkeys(range(n + 1), 1.0), "grown_shard")
    return slots(both, "doc_id", order=["size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


_BYTES = "list_transform(range(0, octet_length(encode(t))::BIGINT), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)"


def _crc_table() -> str:
    return ", ".join(str(_entry(i)) for i in range(256))


def _entry(i: int) -> int:
    for _ in range(8):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
tab AS (SELECT [{_crc_table()}]::BIGINT[] AS tab),
c AS (
  SELECT doc_id, octet_length(encode(t))::BIGINT + 1 AS size,
    xor(list_reduce({_BYTES}, lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM d, tab),
s AS (
  SELECT c.*, g.shard, (-1.0::DOUBLE / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#' || g.shard), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) AS score
  FROM c, (SELECT unnest(range(0, 9))::INT AS shard) g),
w AS (
  SELECT doc_id, size, text_crc32, arg_max(shard, score) FILTER (WHERE shard < 8) AS shard, arg_max(shard, score) AS grown_shard
  FROM s GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM w"""
