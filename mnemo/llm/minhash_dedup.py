"""MinHash near-duplicates with sequential Bayesian verification.

Banded MinHash buckets propose pairs; signatures are compared batch by batch, and a pair is dropped as
soon as the posterior probability of similarity >= the threshold falls under MISS; survivors are
verified on full shingle sets. Work on copies is linear: equal shingle sets are one class from the
start, and a bucket first compares its members with its least member only. Only members of a bucket
that still lie in different components afterwards are compared with each other, inside tasks and in
blocks, and a task gives back no more pairs than connect what it found.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import components, saved, unused

WIDTH = 5
#: Similarity as a ratio of integers, so that the exact test has no rounding.
NUM, DEN = 75, 100
#: BANDS bands of ROWS hashes: a pair at 0.75 shares no band with probability (1 - .75**4)**40 = 2.5e-7.
BANDS, ROWS = 40, 4
#: Hashes compared before each Bayesian test, and the miss probability it may prune at.
BATCH, MISS = 32, 1e-6
#: Rows of a block of a bucket.
BLOCK = 1000

_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_WORD = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: Powers for places of bytes in a word: of the lower 16 bits of a place, and of what is above.
_POW = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64))
_FAR = np.cumprod(np.full(1 << 15, _POW[-1], dtype=np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the 5-word shingles, sorted; of the whole sequence if it has fewer words."""
    raw = np.frombuffer((text or "").encode().translate(_LOWER), dtype=np.uint8)
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(raw)) - np.concatenate([np.zeros(starts[0], dtype=np.int64), np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    value = np.where(gap, np.uint64(0), _BYTE[raw] * _POW[place & 0xFFFF])
    if place.max() > 0xFFFF:
        value *= np.where(place > 0xFFFF, _FAR[np.maximum(place >> 16, 1) - 1], np.uint64(1))
    word = _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    n = len(word)
    if n < WIDTH:
        h = np.array([np.sum(word * _WORD[:n], dtype=np.uint64) + np.uint64(n)])
    else:
        h = sum(word[k : n - WIDTH + 1 + k] * _WORD[k] for k in range(WIDTH))
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-wise hashes of 32 bits."""
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(s), 512):  # bounded memory for very long texts
        np.minimum(least, ((s[at : at + 512, None] * _A + _B) >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
    return least


def _posterior(matches: int, n: int) -> float:
    """P(similarity >= NUM/DEN | matches of n) under a uniform prior: a binomial tail, as both counts are integers."""
    t = NUM / DEN
    return sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(matches + 1))


#: After each batch, the least number of equal hashes with which a pair goes on.
LEAST = [min(m for m in range(n + 1) if _posterior(m, n) >= MISS) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test; later batches see survivors only."""
    live, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(LEAST):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        equal[live] += (a[live, cut] == b[live, cut]).sum(axis=1, dtype=np.int32)
        live = live[equal[live] >= least]
    out = np.zeros(len(a), dtype=bool)
    out[live] = True
    return out


def _sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for text in f["text"]:
            s = shingle_set(text)
            i = np.arange(len(s), dtype=np.uint64)
            rows.append((len(s), int(_mix(s + i).sum(dtype=np.uint64).view(np.int64)), int(_mix(s ^ (i * np.uint64(0x9E3779B97F4A7C15))).sum(dtype=np.uint64).view(np.int64)), signature(s).tobytes() if len(s) else None))
        out = pd.DataFrame(rows, columns=["n", "set_a", "set_b", "sig"])
        out.insert(0, "doc_id", f["doc_id"].array)
        yield out


def _bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if not len(f):
            continue
        sig = np.frombuffer(b"".join(f["sig"]), dtype=np.uint32).reshape(len(f), BANDS, ROWS).astype(np.uint64)
        key = _mix(sum(sig[:, :, r] * _WORD[r] for r in range(ROWS)) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield pd.DataFrame({"bucket": key.ravel().view(np.int64), "doc": np.repeat(f["doc"].to_numpy(), BANDS)})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), BANDS * ROWS)


def _surviving(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            yield f.loc[passes(_matrix(f["sig_a"]), _matrix(f["sig_b"])), ["a", "b"]]


class _Groups:
    """Union-find over whatever is named."""

    def __init__(self):
        self.up = {}

    def top(self, x):
        while (u := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(u, u)
            x = u
        return x

    def join(self, x, y) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[x] = y
        return x != y


def _sides(f: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each stranger of the left block: its place, and the places of survivors of the right block in other
    components. Two strangers are looked at once, from the lesser."""
    left, right = np.flatnonzero(f["left"]), np.flatnonzero(~f["left"])
    if not len(left) or not len(right):
        return
    sig, label, doc, strange = _matrix(f["sig"]), f["label"].to_numpy(), f["doc"].to_numpy(), f["strange"].to_numpy()
    for i in left:
        at = right[(label[right] != label[i]) & (~strange[right] | (doc[right] > doc[i]))]
        yield i, at[passes(np.broadcast_to(sig[i], (len(at), BANDS * ROWS)), sig[at])]


def _suspects(f: pd.DataFrame) -> pd.DataFrame:
    """Documents of one bucket that survive the test with one of another component, as few pairs as name
    them all and connect their components."""
    doc, label, groups, seen, out = f["doc"].to_numpy(), f["label"].to_numpy(), _Groups(), set(), []
    for i, at in _sides(f):
        for j in at:
            if groups.join(label[i], label[j]) or i not in seen or j not in seen:
                out.append((doc[i], label[i], doc[j], label[j]))
                seen |= {i, j}
    return pd.DataFrame(out, columns=["a", "label_a", "b", "label_b"], dtype="int64")


def _settle(f: pd.DataFrame) -> pd.DataFrame:
    """Exact links between the components of two blocks of one family, as few as connect what is linked."""
    doc, label, groups, out = f["doc"].to_numpy(), f["label"].to_numpy(), _Groups(), []
    ids = np.unique(np.concatenate(f["shingles"].to_list()), return_inverse=True)[1].ravel()
    sizes = np.array([len(x) for x in f["shingles"]])
    sets = np.split(ids, np.cumsum(sizes)[:-1])
    own = np.zeros(ids.max() + 1, dtype=bool)
    for i, at in _sides(f):
        at = np.array([j for j in at if groups.top(label[i]) != groups.top(label[j])], dtype=np.int64)
        if not len(at):
            continue
        own[sets[i]] = True
        common = np.add.reduceat(own[np.concatenate([sets[j] for j in at])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
        own[sets[i]] = False
        for j in at[DEN * common >= NUM * (sizes[i] + sizes[at] - common)]:
            if groups.join(label[i], label[j]):
                out.append(sorted((doc[i], doc[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def in_blocks(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, doc, label) of groups dealt to pairs (i, j) of blocks of BLOCK rows: block i of the group's
    strangers, with left set, meets block j of all its members.

    Strangers are the members outside the component that the most members belong to; pairs inside it need no
    look. So rows are copied once for each block of the other side: m members with s strangers make
    2 * m * s / BLOCK rows, not m * m / BLOCK, and few strangers of a large family cost little."""
    sizes = rows.groupBy(group, "label").agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("m"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n"))
    sizes = saved(sizes.select(group, "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"), F.ceil((F.col("m") - F.col("n")) / BLOCK).cast("int").alias("ks")), "sizes")
    x = rows.join(sizes, group).withColumn("strange", F.col("label") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("doc", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strangers = x.where("strange").select("*", block("ks").alias("i"), every("k").alias("j"), F.lit(True).alias("left"))
    members = x.where("ks > 0").select("*", every("ks").alias("i"), block("k").alias("j"), F.lit(False).alias("left"))
    return strangers.unionByName(members).drop("main", "k", "ks")


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"doc": f["doc"], "shingles": [shingle_set(t).view(np.int64) for t in f["text"]]})


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= 75 * union."""
    # texts meet ids by a merge join at every size: the number of ids grows with the corpus
    needed = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(needed.hint("merge"), "doc")
    sets = saved(texts.mapInPandas(_sets, "doc long, shingles array<long>"), "sets")
    a, b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return both.where(DEN * F.col("common") >= NUM * (F.col("total") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept.

    Linked are documents with 100 * intersection >= 75 * union of their distinct 5-word shingles. Null,
    empty and blank texts have no shingles, are linked with nothing and kept. Rows with a null doc_id are
    linked with nothing either: component_id null, kept. Repeated rows give a row each and are equal
    copies; rows that repeat a doc_id with different texts count as different texts of that document.
    Texts are read whole; columns other than doc_id and text are not read. Shingles are compared by 64-bit
    hashes: two different ones are equal with a probability of 5e-20.
    """
    spark = docs.sparkSession
    sketch = saved(docs.select("doc_id", "text").mapInPandas(_sketches, "doc_id long, n long, set_a long, set_b long, sig binary"), "sketch")
    same = ["n", "set_a", "set_b"]
    linked = sketch.where("n > 0 and doc_id is not null")
    # as a table of its own, so that a join with many copies of one class can be split
    classes = saved(linked.groupBy(*same).agg(F.min("doc_id").alias("doc")), "classes")
    # a class whose least id also names another class (a repeated id) still gets its own row here
    sigs = saved(linked.groupBy("doc_id", *same).agg(F.first("sig").alias("sig")).join(classes.select(*[F.col(c).alias("_" + c) for c in same], "doc"), (F.col("doc_id") == F.col("doc")) & (F.col("n") == F.col("_n")) & (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b"))).select("doc", "sig"), "sigs")
    buckets = sigs.mapInPandas(_bands, "bucket long, doc long")
    heads = buckets.groupBy("bucket").agg(F.min("doc").alias("head"), F.count("*").alias("members")).where("members > 1")
    members = saved(buckets.join(heads, "bucket"), "buckets")

    stars = members.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    links = saved(verified(saved(_test(stars, sigs), "pairs"), docs), "links")
    labels = components(links)
    labels = components(links.union(_across(members, labels, sigs, docs)))
    of_class = classes.join(labels.toDF("doc", "label"), "doc", "left").select(*same, F.coalesce("label", "doc").alias("component"))
    out = sketch.join(of_class, same, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component).cast("long")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.coalesce(component, F.lit(-1)) == F.coalesce("doc_id", F.lit(-1))).alias("kept"))


def _test(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    with_a = pairs.join(sigs.toDF("a", "sig_a"), "a")
    return with_a.join(sigs.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b").mapInPandas(_surviving, "a long, b long")


def _across(members: DataFrame, labels: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between members of one bucket that lie in different components.

    First each bucket names its suspects; suspects that hang together make a family, and the full sets of
    a family are then compared block by block. Every pair that shares a bucket and survives the Bayesian
    test is in one family, so no such link is lost.
    """
    named = members.join(labels.toDF("doc", "label"), "doc", "left").select("bucket", "doc", F.coalesce("label", "doc").alias("label"))
    split = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.min("doc").alias("d"), F.count("*").alias("m")).where("low < high")
    # buckets with the same members need one look only
    one = split.groupBy("x", "m", "d").agg(F.min("bucket").alias("bucket")).select("bucket")
    rows = saved(named.join(one, "bucket"), "split")
    suspects = saved(in_blocks(rows, "bucket").join(sigs, "doc").groupBy("bucket", "i", "j").applyInPandas(_suspects, "a long, label_a long, b long, label_b long"), "suspects")
    family = components(suspects.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), "family").toDF("label", "family")
    named = suspects.select(F.col("a").alias("doc"), F.col("label_a").alias("label")).union(suspects.select("b", "label_b")).distinct().join(family, "label")
    named = saved(named, "families")
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(named.select("doc").hint("merge"), "doc", "left_semi")
    sets = texts.mapInPandas(_sets, "doc long, shingles array<long>")
    rows = in_blocks(named, "family").join(sigs, "doc").join(sets, "doc")
    return saved(rows.groupBy("family", "i", "j").applyInPandas(_settle, "a long, b long"), "links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents kept by near_duplicates, with their own columns; of rows that repeat a kept id, all. Rows
    with a null id, a null or an empty text stay; an empty table stays empty."""
    name = unused(docs, "_gone")
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
