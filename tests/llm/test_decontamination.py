import random

from pyspark.sql import functions as F

from mnemo.llm import decontamination as d
from tests.llm.test_dedup import sets_of


def runs(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 9, 20, 40])))) for i in range(30)] + [(30, None), (31, " "), (32, "Solo")]
    docs = []
    for i in range(200):
        w = [word() for _ in range(r.choice([0, 3, 50, 800]))]
        if i % 2:
            it = items[r.randrange(30)][1].upper().split()
            cut = r.choice([0, 0, 1, 3])
            at = r.randrange(len(w) + 1)
            w[at:at] = it[cut:]
        docs.append((i, " ".join(w)))
    docs += [(300, None), (301, ""), (302, items[3][1]), (302, items[3][1]), (303, "solo")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in d.containment(df, it).collect()}
    want = set()
    for i, t in docs:
        for j, u in items:
            b = sets_of(u)
            a = runs(t, min(5, len((u or "").split())))  # short items are runs of their own length
            if b and len(a & b) >= 0.75 * len(b):
                want.add((i, j, len(b), len(a & b)))
    assert got == want and len(want) > 50
    kept = d.decontaminate(df, it)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, *_ in want}
    none = it.where("item_id < 0")
    assert d.containment(df, none).count() == 0 and d.containment(df.where("doc_id < 0"), it).count() == 0


def test_the_bitmap_keeps_every_sketched_hash_and_few_others(spark):
    h = spark.range(400).select(F.xxhash64("id").alias("h"))
    bits, size = d.bitmap(h, 400)
    other = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h"))
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    taken = F.getbit(F.get(bits, F.shiftrightunsigned(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
    assert h.where(taken).count() == 400 and other.where(taken).count() < 0.03 * 20_000
