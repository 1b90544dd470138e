"""Removing repeated byte strings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every LENGTH-byte string but the first in (doc_id, start) order is covered. Strings are dealt by their
minimizer: of the GRAM-byte grams inside a string, that with the least hash (the leftmost of equal ones)
owns it, so equal strings have equal owners at equal places and each occurrence of an owner brings a run
of strings in one short context. Occurrences whose whole contexts are equal repeat the first of them and
need no comparison. What is left are owners with several different contexts: the distinct contexts of a
bucket of owners are joined, their transform is built, and intervals of common prefixes are expanded
backward, breadth-first, one byte a level, until LENGTH: suffixes that are still together then share
LENGTH bytes, and all but the earliest are covered. Contexts that are equal are told by 128 bits of hashes
and not compared by bytes; two different ones pass for equal with a probability of 3e-39.

An owner with many different contexts is no bucket of its own: its strings are dealt further by what
stands beside it. A string reaches far beyond the owner on its left or on its right, so equal strings have
the same bytes on that side, and the same holds again for the stretch so known.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import broadcast_if_small, drop_path, freed, saved, scratch_path

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of contexts in one transform, about, so that its arrays stay in a core's cache.
TRANSFORM = 400_000
#: Different contexts from which an owner's strings are dealt further, and how often.
HOT, LEVELS = 500, 3
#: A run of strings is one number: which of the texts of its id, first string, number of strings (69 at most).
TWIN, FIRST = 38, 7
_B = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-byte strings, by doubling and joining powers of two."""
    piece, width, out, done = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if n & width:
            if out is None:
                out = piece
            else:
                m = len(raw) - done - width + 1
                out = out[:m] * np.uint64(pow(int(_B), width, 2**64)) + piece[done : done + m]
            done += width
        if done == n:
            return _mix(out)
        piece = piece[: len(piece) - width] * np.uint64(pow(int(_B), width, 2**64)) + piece[width:]
        width *= 2


def owners(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the LENGTH-byte strings of a text: owners' gram hashes, their places, and the first string and the
    number of strings of each run."""
    if len(raw) < LENGTH:
        e = np.empty(0, dtype=np.int64)
        return e.astype(np.uint64), e, e, e
    h = _grams(raw, GRAM)
    # the least of SPAN values from each place, leftmost of equal ones, by doubling
    place, width = np.arange(len(h)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] < h[a], b, a)

    while width * 2 <= SPAN:
        place = better(place[: len(place) - width], place[width:])
        width *= 2
    n = len(raw) - LENGTH + 1
    place = better(place[:n], place[SPAN - width : SPAN - width + n])
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return h[place[first]], place[first], first, np.diff(first, append=n)


def _occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (owner, context, doc_id, span): context hashes the run's bytes and where in it the owner is."""
    for f in frames:
        for at in range(0, len(f), 200):
            own, ctx, doc, span = [], [], [], []
            g = f.iloc[at : at + 200]
            for i, twin, text in zip(g["doc_id"].array, g["twin"].array, g["text"], strict=True):
                raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
                g, place, first, n = owners(raw)
                if not len(g):
                    continue
                size = n + LENGTH - 1
                c = _stretch(raw, first, size)
                own.append(g)
                ctx.append(_mix(c + (size * 131 + (place - first)).astype(np.uint64)))
                span.append((twin << TWIN) + (first << FIRST) + n)
                doc.append(np.full(len(g), i, dtype=np.int64))
            if own:
                yield pd.DataFrame({"owner": np.concatenate(own).view(np.int64), "context": np.concatenate(ctx).view(np.int64), "doc_id": np.concatenate(doc), "span": np.concatenate(span)})


_INVERSE = pow(int(_B), -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _stretch(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of stretches: differences of prefix sums of byte * power, brought to one power."""
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_mix(raw.astype(np.uint64) + np.uint64(257)) * _powers(int(_B), len(raw)), out=total[1:])
    return (total[first + size] - total[first]) * _powers(_INVERSE, len(raw) + 1)[first]


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a text up to depth symbols, by prefix doubling; ties stay in text order."""
    rank, width = text.astype(np.int64), 1
    n = len(rank)
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        if n > width:
            nxt[: n - width] = rank[width:] + 1
        key = rank * (int(nxt.max(initial=0)) + 1) + nxt
        order = np.argsort(key, kind="stable")
        if width * 2 >= depth:
            return order
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        rank, width = new, width * 2


def expand(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix order, whether its suffix shares `length` symbols with the one before.

    Level l holds the boundaries between suffixes whose common prefix is of l - 1 symbols or less. A pair
    of neighbours c + x, c + y is told apart on level l + 1 if a boundary of level l lies between x and y:
    the interval of a string w expands backward to those of c + w through the transform's last-to-first
    map. Only pairs that are still together are looked at on the next level.
    """
    n = len(order)
    place = np.empty(n + 1, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    place[n] = -1  # the empty suffix sorts before all
    first = text[order]
    apart = np.ones(n, dtype=bool)
    apart[1:] = first[1:] != first[:-1]
    live = np.flatnonzero(~apart)
    left, right = place[order[live - 1] + 1], place[order[live] + 1]
    for _ in range(length - 1):
        if not len(live):
            break
        interval = np.cumsum(apart, dtype=np.int32)
        split = (left < 0) | (right < 0) | (interval[left] != interval[right])
        apart[live[split]] = True
        live, left, right = live[~split], left[~split], right[~split]
    return ~apart


def _covered(f: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket's contexts: strings that equal an earlier one, as runs (doc_id, span)."""
    f = f.sort_values(["doc_id", "span"], kind="stable")
    span = f["span"].to_numpy()
    count = span & ((1 << FIRST) - 1)
    size = count + LENGTH - 1
    ends = np.cumsum(size + 1)
    text = np.zeros(int(ends[-1]), dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(f["bytes"]), dtype=np.uint8).astype(np.int64) + 1
    order = transform(text, LENGTH)
    together = expand(text, order, LENGTH)
    # separators are equal symbols; a string that meets one starts too late in its context to be a string
    row = np.repeat(np.arange(len(f)), size + 1)
    at = np.arange(len(text)) - np.repeat(ends - size - 1, size + 1)
    whole = at < count[row]
    group = np.cumsum(~together)
    doc, place = f["doc_id"].to_numpy()[row], (span >> FIRST)[row] + at  # place: text of the id, then start
    use = whole[order]
    o, g = order[use], group[use]
    # contexts are sorted, but runs of one text overlap: the earliest is by place, not by row
    by = np.lexsort((place[o], doc[o], g))
    o, g = o[by], g[by]
    same = (np.diff(g, prepend=-1) == 0) & ~((np.diff(doc[o], prepend=-1) == 0) & (np.diff(place[o], prepend=-1) == 0))
    hit = np.sort(o[same])
    new = (np.diff(hit, prepend=-9) != 1) | (np.diff(row[hit], prepend=-1) != 0)
    head = np.flatnonzero(new)
    return pd.DataFrame({"doc_id": doc[hit[head]], "span": (place[hit[head]] << FIRST) + np.diff(head, append=len(hit))}).astype("int64")


def _dealt(raw: bytes, at: int, count: int) -> Iterator[tuple[int, int, int]]:
    """The strings of a context whose owner stands at a place, dealt by what is beside it: key, first, count."""
    parts = [(0, count, at, at + GRAM, zlib.crc32(raw[at : at + GRAM]))]
    for _ in range(LEVELS):
        finer = []
        for low, high, a, b, key in parts:  # strings from low to before high all hold the bytes from a to b
            half = (LENGTH - (b - a)) // 2
            cut = min(max(a - half + 1, low), high)
            if low < cut:
                finer.append((low, cut, a - half, b, zlib.crc32(raw[a - half : a], key)))
            if cut < high:
                finer.append((cut, high, a, b + half, zlib.crc32(raw[b : b + half], key ^ 1)))
        parts = finer
    for low, high, _, _, key in parts:
        yield key, low, high - low


def _cut(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for i, text, runs in zip(f["doc_id"].array, f["text"], f["asked"], strict=True):
            raw = (text or "").encode()
            for r in runs:
                span = r["span"]
                first, count = span >> FIRST & (1 << TWIN - FIRST) - 1, span & (1 << FIRST) - 1
                own = raw[first : first + count + LENGTH - 1]
                if not r["hot"]:
                    out.append((r["bucket"], i, span, own))
                    continue
                at = int(np.argmin(_grams(np.frombuffer(own, dtype=np.uint8), GRAM)[:SPAN]))
                for key, low, n in _dealt(own, at, count):
                    out.append((key % buckets, i, span + (low << FIRST) + n - count, own[low : low + n + LENGTH - 1]))
        yield pd.DataFrame(out, columns=["bucket", "doc_id", "span", "bytes"])


OWNERS = "owner long, context long, doc_id long, span long"


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, span): runs of strings of docs (doc_id, twin, text) that also start earlier. Runs may touch or overlap."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "owners")
    docs.where(F.octet_length("text") >= LENGTH).mapInPandas(_occurrences, OWNERS).write.parquet(path)
    occ = spark.read.schema(OWNERS).parquet(path)
    again = occ.groupBy("owner").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    again = saved(again.select("owner", (F.col("low") != F.col("high")).alias("several")), "again")
    freed(spark)
    occ = saved(occ.join(again, "owner"), "repeated")
    drop_path(spark, path)  # what follows reads the repeated owners only
    freed(spark)
    runs = saved(occ.groupBy("owner", "context", "several").agg(F.min(F.struct("doc_id", "span")).alias("lead"), F.count("*").alias("n")).select("owner", "context", "several", "lead", "n"), "runs")
    twice = runs.where("n > 1").select("owner", "context", F.col("lead.doc_id").alias("lead_doc"), F.col("lead.span").alias("lead_span"))
    repeats = occ.join(twice, ["owner", "context"]).where("doc_id <> lead_doc or span <> lead_span").select("doc_id", "span")
    asked = runs.where("several").select("owner", "lead.*")
    total = asked.agg(F.sum(F.col("span").bitwiseAND(F.lit((1 << FIRST) - 1)) + LENGTH)).first()[0]
    if not total:
        return repeats
    buckets = max(1, -(-total // TRANSFORM))
    hot = saved(asked.groupBy("owner").count().where(F.col("count") >= HOT).select("owner", F.lit(True).alias("hot")), "hot")
    asked = asked.join(broadcast_if_small(hot, hot.count()), "owner", "left")
    own = F.struct(F.pmod(F.xxhash64("owner"), F.lit(buckets)).alias("bucket"), "span", F.coalesce("hot", F.lit(False)).alias("hot"))
    lists = asked.groupBy("doc_id", F.shiftright("span", TWIN).alias("twin")).agg(F.collect_list(own).alias("asked"))
    contexts = docs.join(lists, ["doc_id", "twin"]).select("doc_id", "text", "asked").mapInPandas(lambda frames: _cut(frames, buckets), "bucket long, doc_id long, span long, bytes binary")
    return repeats.unionByName(contexts.groupBy("bucket").applyInPandas(_covered, "doc_id long, span long"))


def told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, twin, text: twin numbers the different texts of one id, by their hashes; equal rows share it."""
    text = docs.select("doc_id", "text").withColumn("_v", F.xxhash64("text"))
    versions = text.where("doc_id is not null").select("doc_id", "_v").distinct()
    twins = versions.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twins.limit(1).count():
        return docs.select("doc_id", F.lit(0).cast("long").alias("twin"), "text")
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("_v")) - 1).cast("long")
    numbers = saved(versions.join(twins, "doc_id").select("doc_id", "_v", number.alias("twin")), "twins")
    return text.join(numbers, ["doc_id", "_v"], "left").select("doc_id", F.coalesce("twin", F.lit(0)).alias("twin"), "text")


def _strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for i, text, runs in zip(f["doc_id"].array, f["text"], f["runs"], strict=True):
            raw = (text or "").encode()
            kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
            if runs is not None:
                end = -1
                firsts = ((r >> FIRST & (1 << TWIN - FIRST) - 1, r & (1 << FIRST) - 1) for r in runs)
                for r in sorted((first, first + count + LENGTH - 1) for first, count in firsts):
                    if r[0] > end:  # touching runs are one
                        kept.update(raw[at : r[0]])
                        spans += 1
                        removed += r[1] - r[0]
                        at = end = r[1]
                    elif r[1] > end:
                        removed += r[1] - end
                        at = end = r[1]
            kept.update(raw[at:])
            out.append((i, len(raw), removed, spans, kept.hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Whole texts count as UTF-8 bytes; null and empty texts have no bytes and keep the digest of nothing;
    matches never cross documents. Rows that repeat a doc_id and a text are one document with the same
    strings, so neither covers the other and each is returned; different texts of one doc_id are different
    documents, in the order of a hash of their text; rows with a null id are compared with nothing. Only
    doc_id and text are read. A task holds a text with some 100 bytes for each of its bytes.
    """
    docs = told_apart(docs)
    found = saved(covered(docs.where("doc_id is not null")), "covered")
    freed(docs.sparkSession)
    runs = found.groupBy("doc_id", F.shiftright("span", TWIN).alias("twin")).agg(F.collect_list("span").alias("runs"))
    joined = docs.join(runs, ["doc_id", "twin"], "left").select("doc_id", "text", "runs")
    return joined.mapInPandas(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
