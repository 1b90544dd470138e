"""Document fingerprints: one-permutation MinHash with optimal densification, low-order bits, bias correction.

Every shingle is hashed once; the top bits of the hash choose a bin and the least hash of each bin is
kept. An empty bin takes the value of a filled one: each bin has its own random order of all bins and
takes the first filled bin of that order, which two documents share when they share the bins. Of the
values only low-order bits are stored; chance agreements are taken out of the estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.minhash_dedup import _mix, shingle_set

#: 2**BIN_BITS bins, each stored with LOW_BITS bits.
BIN_BITS, LOW_BITS = 8, 4
BINS = 1 << BIN_BITS
#: Ranges of ids for each shuffle partition, so that partitions get like shares.
RANGES = 8

_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
_SALT = np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: _RANK[i, j]: the place of bin j in the order in which bin i looks for a filled one.
_RANK = np.argsort(np.argsort(_mix(_SALT[:, None] ^ _mix(_SALT)[None] * np.uint64(0xD1B54A32D192ED03)), axis=1), axis=1).astype(np.int16)


def bins_of(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin, empty bins filled; shingles are sorted distinct 64-bit hashes, at least one."""
    at = np.searchsorted(shingles, _EDGES)
    end = np.append(at[1:], len(shingles))
    filled = np.flatnonzero(end > at)
    source = np.arange(BINS)
    if len(filled) < BINS:
        empty = np.flatnonzero(end == at)
        source[empty] = filled[_RANK[empty][:, filled].argmin(axis=1)]
    return shingles[at[source]]


def sketch(text: str | None) -> np.ndarray | None:
    """LOW_BITS bits a bin; None for a text without words. The bin's number goes into the bits, so that
    bins filled from one source agree by chance independently of each other."""
    s = shingle_set(text)
    return (_mix(bins_of(s) ^ _SALT) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8) if len(s) else None


def packed(bits: np.ndarray | None) -> str:
    """The fingerprint as lowercase hex, two bins a byte; empty for a text without words."""
    return "" if bits is None else ((bits[::2] << 4) | bits[1::2]).tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray | None:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    return np.stack([raw >> 4, raw & 15], axis=1).ravel() if len(raw) else None


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity of two sketches, 0 to 1. Two texts without words are alike, one is not."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-LOW_BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many code points of the start of the following text, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints: a scan without a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f[into] = [packed(sketch(t)) for t in f[text]]
            yield f

    return docs.mapInPandas(run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + f", {into} string")


def _ranged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, extra): rows dealt by ranges of ids. The first row of the range that follows is in
    a range too, marked extra; a range is ordered by descending id. Ids only are read to find the ranges;
    the driver gets one number a range, RANGES a shuffle partition."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").cast("double").alias("_x"))
    probs = [i / (RANGES * n) for i in range(1, RANGES * n)]
    found = number.agg(F.percentile_approx("_x", probs, 100 * RANGES * n)).head()[0] or []
    splits = [-float("inf"), *sorted(set(found)), float("inf")]
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="_x", outputCol="_p", handleInvalid="keep").transform(number.withColumn("_x", F.coalesce("_x", F.lit(float("nan")))))
        part = F.when(F.isnan("_x"), -1).otherwise(F.col("_p").cast("int"))
    else:
        placed, part = number, F.when(F.col("_x").isNull(), -1).otherwise(0)
    placed = placed.select("doc_id", "text", part.alias("part"))
    heads = sorted(((r.part, r.top) for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    to = [(top, heads[i - 1][0], part) for i, (part, top) in enumerate(heads)]  # the range before takes this one's head; the last one takes the first head
    extra = spark.createDataFrame([(part, top, before) for top, before, part in to], f"part int, top {docs.schema['doc_id'].dataType.simpleString()}, before int")
    both = placed.join(F.broadcast(extra), "part", "left")
    one = lambda p, x: F.struct(p.alias("part"), F.lit(x).alias("extra"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(one(F.col("part"), False), one(F.col("before"), True))).otherwise(F.array(one(F.col("part"), False)))
    return both.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.part", "c.extra").repartition(n, "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text")


OUT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ranges in order; one row is held until the next one comes."""
    held = None
    for f in frames:
        rows = []
        for doc_id, text, part, extra in zip(f["doc_id"], f["text"], f["part"], f["extra"], strict=True):
            if extra and held is None:
                continue  # a further row of the id that heads the next range
            bits = sketch(text)
            if held is not None:
                if held[0] != part:
                    raise RuntimeError("a range lacks the head of the next one")
                _, own_id, own, own_bits = held
                new = edited(own, text)
                new_bits = sketch(new)
                rows.append((own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), packed(own_bits), packed(new_bits), likeness(own_bits, new_bits), likeness(own_bits, bits)))
            held = None if extra else (part, doc_id, text, bits)
        yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the last third taken from the next document, and how
    alike the fingerprint is to that one's and to the next document's.

    The next document is the one after it by descending doc_id (after the last the first; a single one is
    its own next). Null texts are empty; null ids come last; rows with equal ids are ordered by text;
    repeated rows stay; an empty table gives no rows; other columns are not carried. A task holds one batch
    of whole texts and the row before it; each text is shuffled once."""
    ordered = _ranged(docs).withColumn("doc_id", F.col("doc_id").cast("string"))  # as numbers, ids beside nulls would turn into floats
    return ordered.mapInPandas(_pairs, OUT).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
