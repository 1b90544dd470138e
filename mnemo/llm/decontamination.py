"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Test items are short and documents long, so the Jaccard similarity of the two is near zero however
complete the leak is, and banded MinHash signatures of whole documents cannot find it. Here the items
are the partitioned side: items are classed by size (powers of two of their shingle count), each item
is sketched by its min-wise hashes (its SKETCH smallest shingle hashes), and each class has the hash
bound that its sketches stay under. A document is probed with those of its own shingles that stay under
the bound of a class it is large enough to contain, and of them only with those whose place in a bitmap
of all sketches is taken, and meets the sketches of such classes only. A document holding a share c of an
item's shingles misses the whole sketch with a probability of at most (1 - c) ** SKETCH, 4e-6 at
c = 0.75; the bitmap loses nothing. Hits are then verified on full shingle sets. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import broadcast_if_small, let, saved, unused, words

WIDTH, SHARE, SKETCH = 5, 0.75, 9
#: Bits of the bitmap for each sketched hash, and its bits at most: beyond, more shingles are probed, none less.
SPREAD, MOST_BITS = 64, 1 << 22


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of WIDTH words; of the whole sequence if it is shorter; in order, with repeats."""
    return let(words(text), lambda w: F.transform(_starts(w), lambda i: _hash(w, i, WIDTH)))


def _hash(w: Column, i: Column, width: int) -> Column:
    """Of the words from i on; a run of fewer than WIDTH words is filled up with nulls."""
    return F.xxhash64(*[F.get(w, i + k) if k < width else F.lit(None).cast("string") for k in range(WIDTH)])


def run_hashes(text: Column, widths: list[int]) -> Column:
    """shingle_hashes, and the hashes of all runs of some smaller numbers of words."""
    runs = lambda w, n: F.when(F.size(w) > n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: _hash(w, i, n))).otherwise(F.array().cast("array<bigint>"))
    return let(words(text), lambda w: F.concat(F.transform(_starts(w), lambda i: _hash(w, i, WIDTH)), *[runs(w, n) for n in widths]))


def shingle_texts(text: Column, width: Column | None = None) -> Column:
    """The shingles as distinct texts, words joined by one space; of another number of words, if it is given."""
    n = F.lit(WIDTH) if width is None else width
    return F.array_distinct(let(words(text), lambda w: F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))))


def _starts(w: Column, width: Column | None = None) -> Column:
    n = F.lit(WIDTH) if width is None else width
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def bitmap(sketch: DataFrame, n: int) -> tuple[Column, int]:
    """The lowest bits of all sketched hashes as an array of longs, and how many bits a hash gives. SPREAD bits a hash,
    MOST_BITS (512 KB) at most, are what comes to the driver."""
    size = min(MOST_BITS, max(64, 1 << (SPREAD * max(1, n) - 1).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    rows = sketch.select(F.shiftrightunsigned(place, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast((h & {size - 1}) & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    longs = ["0"] * (size // 64)
    for r in rows:
        longs[r["at"]] = str(r["bits"])
    return F.split(F.lit(",".join(longs)), ",").cast("array<bigint>"), size  # Spark folds this into one literal


def containment(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """Pairs of documents and test items with at least `share` of the item's distinct shingles in the
    document: doc_id, item_id, item_shingles, shared_shingles, containment.

    An item of fewer than WIDTH words is one shingle of its whole sequence and is found wherever a document
    has that run of words.

    Null, empty and blank texts on either side match nothing; ties do not arise; repeated rows give one
    pair; empty tables give no rows; only doc_id, item_id and text are read of either table.
    """
    text = F.col("text")
    item = items.select("item_id", F.least(F.lit(WIDTH), F.size(words(text))).alias("width"), shingle_texts(text).alias("item_set"), F.array_sort(F.array_distinct(shingle_hashes(text))).alias("h")).where(F.size("h") > 0)
    item = item.withColumn("q", F.size("h")).withColumn("klass", F.floor(F.log2("q")).cast("int"))
    sketch = item.select("item_id", "width", "q", "klass", F.explode(F.slice("h", 1, SKETCH)).alias("h"))
    # at most 31 rows, one a size class
    bounds = sketch.groupBy("klass").agg(F.max("h").alias("bound"), F.min("q").alias("least"), F.count("*").alias("n"), F.collect_set("width").alias("widths")).orderBy("klass").collect()
    n_sketch = sum(r["n"] for r in bounds)
    short = sorted({w for r in bounds for w in r["widths"] if w < WIDTH})
    bits, size = bitmap(sketch, n_sketch)

    def fits(n: Column, r) -> Column:
        """Whether a document of n shingles may hold an item of the class."""
        return n >= F.lit(share) * F.lit(r["least"])

    def top(n: Column) -> Column:
        """The highest hash that any class asks for: null for a document too small for every class."""
        return F.greatest(*[F.when(fits(n, r), F.lit(r["bound"])) for r in bounds], F.lit(None).cast("long"), F.lit(None).cast("long"))

    def taken(h: Column) -> Column:
        place = h.bitwiseAND(F.lit(size - 1))
        return F.getbit(F.get(bits, F.shiftrightunsigned(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    low = let(run_hashes(text, short), lambda h: F.struct(F.size(h).alias("n"), let(top(F.size(h)), lambda t: F.array_distinct(F.filter(h, lambda x: (x <= t) & taken(x)))).alias("h")))
    asked = docs.select("doc_id", low.alias("low")).select("doc_id", "low.n", F.explode("low.h").alias("h"))
    known = broadcast_if_small(sketch.select("item_id", "q", "h"), n_sketch)
    hits = asked.join(known, "h").where(F.col("n") >= F.lit(share) * F.col("q"))
    pairs = saved(hits.select("doc_id", "item_id").distinct(), "pairs")
    # few pairs go to the texts; only many make texts and pairs meet in a shuffle
    pairs = broadcast_if_small(pairs, pairs.count())
    sets = broadcast_if_small(item.select("item_id", "width", "item_set"), n_sketch)
    found = docs.select("doc_id", "text").join(pairs, "doc_id").join(sets, "item_id").select("doc_id", "item_id", "item_set", shingle_texts(text, F.col("width")).alias("doc_set"))
    exact = found.select("doc_id", "item_id", F.size("item_set").cast("long").alias("item_shingles"), F.size(F.array_intersect("doc_set", "item_set")).cast("long").alias("shared_shingles"))
    kept = exact.where(F.col("shared_shingles") >= F.lit(share) * F.col("item_shingles"))
    return kept.groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared_shingles").alias("shared_shingles")).withColumn("containment", F.round(F.col("shared_shingles") / F.col("item_shingles"), 6))


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that contain no test item, with their own columns. Rows with a null id, a null or an empty
    text are kept; of rows that repeat an id all go if one of them holds an item; an empty table stays empty."""
    leak = unused(docs, "_leak")
    leaks = containment(docs, items, share).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, docs["doc_id"] == F.col(leak), "left_anti")


_WORDS = """SELECT {id}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}"""
_RUNS = "unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' ')))) AS s"
SQL = f"""
WITH dw AS ({_WORDS.format(id="doc_id", table="documents")}), bw AS (SELECT *, least(5, len(w)) AS width FROM ({_WORDS.format(id="item_id", table="benchmark")}) WHERE len(w) > 0),
b AS (SELECT item_id, width, {_RUNS} FROM bw), d AS (SELECT doc_id, width, {_RUNS} FROM dw, (SELECT DISTINCT width FROM bw) WHERE len(w) >= width),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM d JOIN b USING (width, s) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared_shingles, round(shared_shingles / item_shingles, 6) AS containment
FROM m JOIN n USING (item_id) WHERE shared_shingles >= 0.75 * item_shingles"""
