"""Cost-balanced packing of token sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (matrix work plus attention). Full-length
pieces of long documents make sequences of their own; the rest is assigned by descending cost to the
lowest-cost sequence with room for all of it, and cut only where no sequence has. The number of
sequences is the least possible, so at most one sequence of a call is not full.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mnemo.llm.tokens import encoder, slices, with_end

CAPACITY, END = 1024, 0
#: Cost of a token and of a pair of tokens; their ratio is that of a model 2048 wide.
LINEAR, QUADRATIC = 12.0 * 2048, 2.0


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Open:
    """Sequences that are not full, by room: a heap by cost for each room, under a tree of least costs."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.least = [(float("inf"), -1, 0)] * (2 * self.width)

    def _settle(self, room: int) -> None:
        least, at, heap = self.least, room + self.width, self.heaps[room]
        least[at] = heap[0] if heap else (float("inf"), -1, room)
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])

    def fill(self, sequences: range, capacity: int) -> None:
        self.heaps[capacity] = [(0.0, s, capacity) for s in sequences]
        self._settle(capacity)

    def put(self, spent: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (spent, sequence, room))
        if self.heaps[room][0][1] == sequence:
            self._settle(room)

    def take(self, room: int) -> tuple[float, int, int] | None:
        """The lowest-cost sequence with that much room or more: cost, sequence, room."""
        least, a, b, best = self.least, room + self.width, 2 * self.width, (float("inf"), -1, 0)
        while a < b:
            if a & 1:
                best = min(best, least[a])
                a += 1
            if b & 1:
                b -= 1
                best = min(best, least[b])
            a >>= 1
            b >>= 1
        if best[1] < 0:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._settle(best[2])
        return best


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each token once; sequences have no gaps.
    Equal pieces go in the order of their documents; of sequences of equal cost the first is taken."""
    pieces, rest, n_seq = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((d, start, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((-(n % capacity), d, n - n % capacity))
    heapq.heapify(rest)
    free = Open(capacity)
    free.fill(range(n_seq, n_seq - (sum(n for n, _, _ in rest) // capacity)), capacity)
    while rest:
        n, d, start = heapq.heappop(rest)
        n = -n
        spent, seq, room = free.take(n) or free.take(1)
        put = min(n, room)
        pieces.append((d, start, put, seq, capacity - room))
        if put < room:
            free.put(spent + cost(put), seq, room - put)
        if put < n:
            heapq.heappush(rest, (put - n, d, start + put))
    return pieces


def padded(used: int, capacity: int = CAPACITY) -> int:
    """A sequence is padded to the capacity, or to a smaller power of two that holds it."""
    return min(capacity, 1 << max(0, used - 1).bit_length())


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Tasks pack what they read in runs of some megabytes of text, so no token is shuffled; sequence_id is (partition << 40)
    plus a count. Whole texts are encoded; null and empty texts are documents of the one end id;
    repeated rows and null ids are documents of their own; an empty table gives no rows; other columns
    are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(vocabulary).encode, TaskContext.get().partitionId() << 40
        for b in slices(batches):
            ids, counts = with_end(*encode(b.column("text")), END)
            pieces = pack(counts.tolist())
            if not pieces:
                continue
            d, start, length, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            used = np.bincount(seq, weights=length).astype(np.int64)
            at = 4 * ((np.cumsum(counts) - counts)[d] + start)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[a:e]) for a, e in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            width = np.array([padded(u) for u in used.tolist()])[seq]
            columns = [b.column("doc_id").cast(pa.int64()).take(pa.array(d)), start, length, np.array(crc, dtype=np.int64), counts[d], seq + base, offset, width]
            base += len(used)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(rows, OUT)
