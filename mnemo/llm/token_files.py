"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Order 2 and order 1 name the id that last followed the same two ids or the same one id; order 0 knows how
often ids occur. An id is coded as an outcome (order 2 is right, order 1 is right, neither) and, if
neither, as the class of its order-0 rank, a power of two, by adaptive counts; its place inside the class
is near uniform and goes out as plain bits. The outcome's probabilities are mixed from two adaptive
contexts (how far both guesses were right before, and the last outcomes) with a weight that moves to the
context that did better. All arithmetic is exact, so every machine decodes alike. Blocks start afresh, and
a task codes its blocks side by side: step t of all blocks is one set of array operations.

A file's rows are segments of whole documents: (part, segment, doc_ids, lengths, n_ids, crc32, ranks,
blocks). crc32 is that of the segment's ids as little-endian unsigned 32-bit integers, ranks the segment's
distinct ids by falling count (the same form), blocks a list of coded blocks of BLOCK ids (the last one
shorter): crc32 of the rest, number of ids, number of coder words, coder words, plain bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import broadcast_if_small, saved
from mnemo.llm.tokens import encoder, slices, with_end

END = 2
#: Ids of a block; blocks coded side by side, at most; ids of a segment before it is closed.
BLOCK, LANES = 512, 8192
SEGMENT = BLOCK * LANES
#: Bits of a lane's order-1 and order-2 tables, of a probability, and steps between updates of the class counts.
SLOT_BITS, T_BITS, EVERY = 6, 12, 64
T = 1 << T_BITS
U = np.uint64
#: Cumulative probabilities that an outcome pulls to, and the steps from one outcome to the next.
_GOALS = np.array([[T - 2, T - 1], [1, T - 1], [1, 2]], np.int16).view(np.int32).ravel()
_GOAL, _TO_1, _TO_2 = _GOALS[0], _GOALS[1] - _GOALS[0], _GOALS[2] - _GOALS[1]


class Model:
    """Predictors of n blocks. Tables are laid out entry by entry with the blocks side by side, so that what
    all blocks use often lies together."""

    def __init__(self, n: int, classes: int):
        self.n, self.stride, self.k = n, n, classes
        self.lane = np.arange(n, dtype=np.int64)
        # entries: the low 14 bits of a rank and how often in a row it was right (0 to 3); greater ranks are never right
        self.two, self.one = np.zeros(n << SLOT_BITS, np.uint16), np.zeros(n << SLOT_BITS, np.uint16)
        even = int(np.array([T // 8, T // 4], np.int16).view(np.int32)[0])
        self.a, self.b = np.full(n << 7, even, np.int32), np.full(n << 7, even, np.int32)
        self.weight, self.past = np.full(n, 128, np.int32), np.zeros(n, np.int32)
        self.x1, self.x2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.seen, self.n_seen = np.empty((EVERY, n), np.int32), 0
        self.counts = np.ones((classes, n), np.int32)
        self._tally()

    def _tally(self) -> None:
        total = np.zeros((self.k + 1, self.n), np.int32)
        np.cumsum(self.counts, axis=0, out=total[1:])
        share = (T - self.k) * total.astype(np.int64) // total[-1]
        self.cum = share.astype(np.int16) + np.arange(self.k + 1, dtype=np.int16)[:, None]
        self.flat = self.cum.ravel()

    def shrink(self, n: int) -> None:
        """The first n blocks have ids left."""
        for k in ("lane", "weight", "past", "x1", "x2"):
            setattr(self, k, getattr(self, k)[:n])
        for k in ("seen", "counts", "cum"):
            setattr(self, k, np.ascontiguousarray(getattr(self, k)[:, :n]))
        self.flat, self.n = self.cum.ravel(), n

    def guess(self) -> None:
        h1 = self.x1 * np.uint32(0x9E3779B1)
        h2 = self.x2 * np.uint32(0x85EBCA77) ^ h1
        cut = np.uint32(32 - SLOT_BITS)
        self.s2 = (h2 >> cut).view(np.int32) * self.stride + self.lane
        self.s1 = (h1 >> cut).view(np.int32) * self.stride + self.lane
        e2, e1 = self.two[self.s2].astype(np.int32), self.one[self.s1].astype(np.int32)
        self.g2, self.g1, self.t2, self.t1 = e2 >> 2, e1 >> 2, e2 & 3, e1 & 3
        near = (self.t2 << 1) | (self.g2 == self.g1)
        self.ia = ((self.t1 << 3) | near) * self.stride + self.lane
        self.ib = ((self.past << 3) | near) * self.stride + self.lane
        self.pa, self.pb = self.a[self.ia], self.b[self.ib]
        a1, a2, b1, b2 = self.pa & 65535, self.pa >> 16, self.pb & 65535, self.pb >> 16
        self.lead = a2 - b2
        self.c1, self.c2 = b1 + ((a1 - b1) * self.weight >> 8), b2 + (self.lead * self.weight >> 8)

    def bounds(self, not2: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the outcome, from 1 where order 2 is wrong and 1 where both are."""
        d = self.c2 - self.c1
        return self.c1 * not2 + d * miss, self.c1 + (d - self.c1) * not2 + (T - self.c2 - d) * miss

    def within(self, start: np.ndarray, size: np.ndarray, cls: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the class where both are wrong."""
        at = cls * self.n + self.lane
        low = self.flat[at]
        wide = (self.flat[at + self.n] - low - T).astype(np.int32)
        return (start << T_BITS) + size * (low * miss), size * (wide * miss + T)

    def learn(self, not2: np.ndarray, miss: np.ndarray, x: np.ndarray, cls: np.ndarray) -> None:
        w = self.weight
        w += (self.lead - (miss << 1) * self.lead) >> 5
        np.minimum(np.maximum(w, 8, out=w), 248, out=w)
        goal = (_GOAL + not2 * _TO_1 + miss * _TO_2).view(np.int16)
        for table, at, p in ((self.a, self.ia, self.pa), (self.b, self.ib, self.pb)):
            p = p.view(np.int16)
            table[at] = (p + ((goal - p) >> 4)).view(np.int32)
        named = x << 2
        self.two[self.s2] = named | ((np.minimum(self.t2, 2) + 1) * (self.g2 == x))
        self.one[self.s1] = named | ((np.minimum(self.t1, 2) + 1) * (self.g1 == x))
        self.past = ((self.past << 2) | (not2 + miss)) & 15
        self.x2, self.x1 = self.x1, x.view(np.uint32)
        self.seen[self.n_seen] = cls
        self.n_seen += 1
        if self.n_seen == EVERY:
            found = np.bincount((self.seen * self.n + self.lane).ravel(), minlength=self.k * self.n)
            self.counts += found.reshape(self.k, self.n).astype(np.int32) * 2
            self.n_seen = 0
            self._tally()


class Writer:
    """Range coders of n blocks. The range stays over 2**32 and gives out 16 bits at a time; the low end is
    under 2**48 but for a carry, which goes into what was given out before."""

    def __init__(self, n: int, words: int):
        self.low, self.range = np.zeros(n, U), np.full(n, U(1 << 48))
        self.out, self.n = np.zeros((words, n), np.uint16), n
        self.flat, self.at = self.out.ravel(), np.arange(n, dtype=np.int64)

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        low, r = self.low[: len(start)], self.range[: len(start)]
        r >>= U(2 * T_BITS)
        low += r * start.astype(U)
        r *= size.astype(U)
        i = np.flatnonzero(r < U(1 << 32))
        while len(i):
            self._emit(i)
            r = self.range[i] << U(16)
            self.range[i] = r
            i = i[r < U(1 << 32)]

    def _emit(self, i: np.ndarray) -> None:
        low, at = self.low[i], self.at[i]
        full = low >> U(48)
        if full.any():
            back = at[full > 0] - self.n
            while len(back):
                self.flat[back] += np.uint16(1)
                back = back[self.flat[back] == 0] - self.n
            low &= U((1 << 48) - 1)
        self.flat[at] = low >> U(32)
        self.at[i] = at + self.n
        self.low[i] = (low << U(16)) & U((1 << 48) - 1)

    def finish(self) -> list[np.ndarray]:
        for _ in range(3):
            self._emit(np.arange(self.n))
        sizes = (self.at // self.n).tolist()
        return [w[:e] for w, e in zip(np.ascontiguousarray(self.out[: max(sizes)].T), sizes, strict=True)]


class Reader:
    def __init__(self, words: np.ndarray):
        self.n, w = len(words), words.astype(U)
        self.words = np.ascontiguousarray(words.T).ravel()
        self.code = w[:, 0] << U(32) | w[:, 1] << U(16) | w[:, 2]
        self.range = np.full(self.n, U(1 << 48))
        self.at = np.arange(self.n, dtype=np.int64) + 3 * self.n

    def target(self, n: int) -> np.ndarray:
        r = self.range[:n]
        r >>= U(2 * T_BITS)
        # exact in floating point: the code is under 2**48 and the divisor 2**8 or more
        return np.minimum((self.code[:n].astype(np.float64) / r.astype(np.float64)).astype(np.int32), (1 << 2 * T_BITS) - 1)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        code, r = self.code[: len(start)], self.range[: len(start)]
        code -= r * start.astype(U)
        r *= size.astype(U)
        i = np.flatnonzero(r < U(1 << 32))
        while len(i):
            at = self.at[i]
            self.code[i] = (self.code[i] << U(16)) | self.words[at]
            self.at[i] = at + self.n
            r = self.range[i] << U(16)
            self.range[i] = r
            i = i[r < U(1 << 32)]


def classes_of(ranks: np.ndarray) -> np.ndarray:
    """The class of each rank: rank + 1 lies in [2**class, 2**(class + 1)). It is the exponent of the number in
    binary floating point, exact for the ranks of a segment, which are under 2**24."""
    return ((ranks + np.int32(1)).astype(np.float32).view(np.int32) >> 23) - 127


def _packed(values: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """The low `bits` bits of the values of each row, one after another, in words of 16 bits."""
    total = np.cumsum(bits, axis=1, dtype=np.int32)
    words = (total[:, -1] + 15) // 16
    ends = np.cumsum(words)
    at = (total - bits).astype(np.int64) + ((ends - words) * 16)[:, None]
    part = (values & ((1 << bits) - 1)).astype(np.int64) << (at & 15)
    at, part, n = (at >> 4).ravel(), part.ravel(), int(ends[-1]) + 2
    # bits of different values never overlap, so a sum is a union
    out = np.bincount(at, part & 65535, n)
    out[1:] += np.bincount(at, part >> 16, n)[:-1]
    return np.split(out[:-2].astype("<u2"), ends[:-1])


def _lanes(lengths: np.ndarray, t: int) -> int:
    """Blocks with an id at step t; only the last block may be shorter."""
    return len(lengths) - (t >= lengths[-1])


def _encoded(ranks: np.ndarray, lengths: np.ndarray, k: int) -> list[bytes]:
    """Blocks of one group, from their ranks, of k classes: a row a block."""
    n, steps = ranks.shape
    ranks = np.ascontiguousarray(ranks.T)
    m, w, missed = Model(n, k), Writer(n, steps * 3 + 8), np.zeros((steps, n), bool)
    for t in range(steps):
        live = _lanes(lengths, t)
        if live < m.n:
            m.shrink(live)
        x = ranks[t, :live]
        cls = classes_of(x)
        m.guess()
        not2 = x != m.g2
        missed[t, :live] = both = not2 & (x != m.g1)
        not2, miss = not2.astype(np.int32), both.astype(np.int32)
        w.put(*m.within(*m.bounds(not2, miss), cls, miss))
        m.learn(not2, miss, x, cls)
    out, words = [], w.finish()
    for at in range(0, n, 512):  # in parts that a cache holds
        own = np.ascontiguousarray(ranks[:, at : at + 512].T)
        out += _packed(own + 1, classes_of(own) * np.ascontiguousarray(missed[:, at : at + 512].T))
    coded = []
    for size, own, plain in zip(lengths.tolist(), words, out, strict=True):
        body = size.to_bytes(4, "little") + len(own).to_bytes(4, "little") + own.astype("<u2").tobytes() + plain.tobytes()
        coded.append(zlib.crc32(body).to_bytes(4, "little") + body)
    return coded


def encode_ids(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The ranks and the coded blocks of ids; each block can be decoded by itself."""
    if not len(ids):
        return b"", []
    if ids.max() < 1 << 24:
        count = np.bincount(ids)
        named, place = np.flatnonzero(count), ids
        count = count[named]
    else:
        named, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.zeros(len(named) if place is not ids else int(named[-1]) + 1, np.int32)
    rank[order if place is not ids else named[order]] = np.arange(len(named), dtype=np.int32)
    ranks, k, coded = rank[place], len(named).bit_length(), []
    for at in range(0, len(ids), BLOCK * LANES):
        own = ranks[at : at + BLOCK * LANES]
        width = min(BLOCK, len(own))
        n = -(-len(own) // width)
        lengths = np.full(n, width)
        lengths[-1] = len(own) - width * (n - 1)
        coded += _encoded(np.pad(own, (0, n * width - len(own))).reshape(n, width), lengths, k)
    return named[order].astype("<u4").tobytes(), coded


def _decoded(blocks: list[np.ndarray], lengths: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    n, steps = len(blocks), int(lengths[0])
    coder = np.zeros((n, int(words.max()) + 4), np.uint16)
    plain = np.zeros((n, max(len(b) - w for b, w in zip(blocks, words.tolist(), strict=True)) + 4), np.uint16)
    for i, (b, w) in enumerate(zip(blocks, words.tolist(), strict=True)):
        coder[i, :w] = b[:w]
        plain[i, : len(b) - w] = b[w:]
    both = np.ascontiguousarray((plain[:, :-1].astype(np.uint32) | plain[:, 1:].astype(np.uint32) << np.uint32(16)).T).ravel()
    m, c, at = Model(n, k), Reader(coder), np.zeros(n, np.int32)
    ranks = np.zeros((steps, n), np.int32)
    for t in range(steps):
        live = _lanes(lengths, t)
        if live < m.n:
            m.shrink(live)
            at = at[:live]
        m.guess()
        v = c.target(live)
        u = v >> T_BITS
        not2, miss = (u >= m.c1).astype(np.int32), (u >= m.c2).astype(np.int32)
        start, size = m.bounds(not2, miss)
        inner = ((v - (start << T_BITS)) / size).astype(np.int16)
        cls = (m.cum[1:-1] <= inner).view(np.int8).sum(axis=0, dtype=np.int8).astype(np.int32)
        c.take(*m.within(start, size, cls, miss))
        bits = cls * miss
        top = 1 << bits
        low = (both[(at >> 4) * n + m.lane] >> (at & 15).view(np.uint32)).view(np.int32) & (top - 1)
        at += bits
        hit = m.g2 + (m.g1 - m.g2) * not2
        x = hit + (low + top - 1 - hit) * miss
        m.learn(not2, miss, x, classes_of(x))
        ranks[t, :live] = x
    return np.ascontiguousarray(ranks.T).ravel()[: int(lengths.sum())]


def decode_ids(ranks: bytes, coded: list[bytes]) -> np.ndarray:
    """The ids of coded blocks in their order, any of a segment; raises ValueError if one is damaged."""
    for k, b in enumerate(coded):
        if zlib.crc32(b[4:]) != int.from_bytes(b[:4], "little"):
            raise ValueError(f"block {k} is damaged")
    if not coded:
        return np.zeros(0, np.uint32)
    named = np.frombuffer(ranks, "<u4")
    heads = np.array([np.frombuffer(b, "<u4", 2, 4) for b in coded], dtype=np.int64)
    out, at = [], 0
    while at < len(coded):  # groups of equal lengths, of which only the last block may be shorter
        end = at + 1
        while end < len(coded) and end - at < LANES and heads[end - 1, 0] == heads[at, 0] >= heads[end, 0]:
            end += 1
        out.append(_decoded([np.frombuffer(b, "<u2", offset=12) for b in coded[at:end]], heads[at:end, 0], heads[at:end, 1], len(named).bit_length()))
        at = end
    return named[np.concatenate(out)]


FILE = "part int, segment int, doc_ids array<long>, lengths array<long>, n_ids long, crc32 long, ranks binary, blocks array<binary>"
_FILE = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("ranks", pa.binary()), ("blocks", pa.list_(pa.binary()))])


def write_ids(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """The files' rows of all documents in ascending doc_id order (null ids first): ids plus an end id.

    Documents are range-partitioned by doc_id and, among rows that repeat an id, a hash of the text, so
    part numbers and segment numbers follow the order; a task holds one segment at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, segment, part, names, lengths, held, n = encoder(vocabulary).encode, 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            ids, own = np.concatenate(held), np.concatenate(lengths).tolist()
            ranks, blocks = encode_ids(ids)
            row = {"part": part, "segment": segment, "doc_ids": list(names), "lengths": own, "n_ids": len(ids), "crc32": zlib.crc32(ids.astype("<u4").tobytes()), "ranks": ranks, "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], _FILE)

        for b in slices(batches):
            part, ids_of = b.column("part")[0].as_py(), b.column("doc_id")
            ids, counts = with_end(*encode(b.column("text")), end)
            done, first, ends = 0, 0, np.cumsum(counts)
            while done < len(counts):
                # documents up to the one that fills the segment
                last = min(len(counts), int(np.searchsorted(ends, first + SEGMENT - n)) + 1)
                names += ids_of.slice(done, last - done).to_pylist()
                lengths.append(counts[done:last])
                held.append(ids[first : ends[last - 1]])
                n += int(ends[last - 1]) - first
                done, first = last, int(ends[last - 1])
                if n >= SEGMENT:
                    yield close()
                    segment, n = segment + 1, 0
                    names.clear(), lengths.clear(), held.clear()
        if n:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return dealt.withColumn("part", F.spark_partition_id()).mapInArrow(rows, FILE)


def read_ids(files: DataFrame) -> DataFrame:
    """One row a document of the files: doc_id, start, n_tokens, ids_crc32; start counts all ids before it.

    Null and empty texts have the end id alone; repeated rows are documents of their own, in the order of
    their texts; an empty table gives no rows. A damaged block or segment raises ValueError.
    """
    # counts only: one row a part in the first window, and the coded blocks stay where they are
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    within = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("_within"))
    starts = within.join(parts, "part").select("part", "segment", (F.col("_before") + F.col("_within")).alias("base"))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, segment, names, lengths, crc32, ranks, blocks in zip(f["part"], f["segment"], f["doc_ids"], f["lengths"], f["crc32"], f["ranks"], f["blocks"], strict=True):
                raw, ends = decode_ids(ranks, list(blocks)).astype("<u4").tobytes(), np.cumsum(lengths)
                if zlib.crc32(raw) != crc32:
                    raise ValueError(f"segment {segment} of part {part} is damaged")
                at, view = ends - np.asarray(lengths), memoryview(raw)
                yield pd.DataFrame({"part": part, "segment": segment, "doc_id": pd.array([None if pd.isna(i) else int(i) for i in names], dtype="Int64"), "at": at, "n_tokens": lengths, "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]})

    out = files.mapInPandas(rows, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return out.join(broadcast_if_small(starts, files.count()), ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame) -> DataFrame:
    return read_ids(saved(write_ids(docs), "ids"))
