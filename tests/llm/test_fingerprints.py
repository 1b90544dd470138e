import hashlib

import numpy as np

from mnemo.llm import fingerprints as fp
from mnemo.llm.minhash_dedup import shingle_set


def jaccard(a, b):
    a, b = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    off = []
    for n in (8, 40, 200, 1500):
        for _ in range(40):
            a = list(rng.choice(words, n))
            b = list(a)
            cut = int(rng.integers(0, n))
            b[cut:] = rng.choice(words, n - cut)
            a, b = " ".join(a), " ".join(b)
            off.append(fp.likeness(fp.sketch(a), fp.sketch(b)) - jaccard(a, b))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.08


def test_unlike_texts_of_one_shingle_agree_by_chance_only():
    s = [fp.sketch(f"text {i}") for i in range(200)]
    assert max(fp.likeness(a, b) for a, b in zip(s, s[1:])) < 0.2
    assert fp.likeness(s[0], fp.sketch("TEXT  0")) == 1.0


def test_packing_and_filling():
    s = fp.sketch("a b c d e f g")
    assert (fp.unpacked(fp.packed(s)) == s).all() and len(fp.packed(s)) == fp.BINS * fp.LOW_BITS // 4
    values = fp.bins_of(shingle_set("a b c d e f g"))
    assert set(values.tolist()) == set(shingle_set("a b c d e f g").tolist()) or len(set(values.tolist())) <= 3
    assert fp.unpacked(fp.packed(None)) is None


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = fp.sketch(t), fp.sketch(e), fp.sketch(nxt)
        out.append((-1 if i is None else i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.packed(a), fp.packed(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in df.collect())


SCHEMA = "doc_id long, text string, part string, n_chars int, fingerprint string"


def frame(spark, rows, n=5):
    return spark.createDataFrame([(i, t, "x", 0, "y") for i, t in rows], SCHEMA).repartition(n)


def test_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), " ".join(rng.choice(list("abcdefghß😀"), int(rng.integers(0, 30))))) for i in rng.permutation(300) * 7]
    rows += [(2**60 + 1, "x " * 30_000), (2**60 + 2, None), (2**60 + 3, ""), (14, "same"), (14, "same"), (14, None), (None, "no id"), (None, None), (-5, "below")]
    assert rows_of(fp.edit_likeness(frame(spark, rows))) == brute(rows)


def test_single_empty_and_equal_ids(spark):
    for rows in ([(1, "one two three four five six")], [(1, "a"), (1, "b"), (1, "c")], [(None, "a b c")], [(3, "abc def"), (2, "xyz uvw")]):
        assert rows_of(fp.edit_likeness(frame(spark, rows, 2))) == brute(rows)
    assert fp.edit_likeness(frame(spark, [], 1)).collect() == []


def test_fingerprint_column(spark):
    out = fp.fingerprints(spark.createDataFrame([("a b c",), (None,), ("A b C",)], "text string")).collect()
    assert out[0].fingerprint == out[2].fingerprint and out[1].fingerprint == ""
