import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemo.llm import minhash_dedup as m

BASE = [f"w{i}" for i in range(60)]


def sets_of(text):
    w = text.translate({i: i + 32 for i in range(65, 91)}).split() if text else []
    w = [x for x in w if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return sorted((i if i is not None else -1, len(s), top(i) if i is not None else None, i is None or top(i) == i) for i, s in sets)


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def edited(k, rng):
    w = list(BASE)
    for at in rng.choice(60, size=k, replace=False):
        w[at] = f"x{rng.integers(1000)}"
    return " ".join(w)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, edited(int(rng.integers(0, 4)), rng)) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE two"), (105, "one"), (106, "a b c d e"), (107, "A B c d e"), (None, "one two")]
    rows += [(200 + i, " ".join(f"v{i}_{j}" for j in range(30))) for i in range(20)] + [(300, "word " * 3000), (301, "Word " * 2000)]
    rows += [(110, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, label int")
    assert rows_of(m.near_duplicates(df)) == brute(rows)


def test_empty_table(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_through_a_later_document(spark):
    """Members that are not near their bucket's least member still meet."""
    a = list(BASE)
    b = a[:4] + ["q"] + a[5:]
    far = ["z%d" % i for i in range(9)] + a[9:]
    near_far = ["z%d" % i for i in range(8)] + ["y"] + a[9:]
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(far)), (3, " ".join(near_far))]
    assert rows_of(m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \t\né", max_size=60))
def test_shingle_counts(text):
    assert len(m.shingle_set(text)) == len(sets_of(text))


def test_sequential_test_keeps_equal_and_drops_unlike():
    a = m.signature(m.shingle_set(" ".join(BASE)))
    b = m.signature(m.shingle_set(" ".join(reversed(BASE))))
    assert m.passes(np.array([a, a]), np.array([a, b])).tolist() == [True, False]
    assert all(m._posterior(x, n) >= m.MISS for x, n in zip(m.LEAST, range(32, 161, 32)))
