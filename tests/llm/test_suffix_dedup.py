import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemo.llm import suffix_dedup as s


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, dtype=bool)
        for a in range(len(raw) - s.LENGTH + 1):
            w = raw[a : a + s.LENGTH]
            if w in seen:
                cover[a : a + s.LENGTH] = True
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        out.append((i, len(raw), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "TRANSFORM", 20_000)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(24)
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101), (5, "ab" * 400), (6, "short")]
    for i in range(10, 90):
        t = text(r.randrange(0, 150))
        kind = i % 8
        if kind == 1:
            t = t + passage + text(20)
        elif kind == 2:
            t = passage[r.randrange(80) : len(passage) - r.randrange(80)] + t
        elif kind == 3:
            t = "\n".join([t[:50], line, t[50:], line, line])
        elif kind == 4 and i > 20:
            t = rows[r.randrange(7, len(rows))][1]
        elif kind == 5:
            w = rows[-1][1].split(" ")
            w[len(w) // 2 :: 40] = ["changed"] * len(w[len(w) // 2 :: 40])
            t = " ".join(w)
        rows.append((i, t))
    rows.append((200, "q" + passage * 30 + "z"))
    r.shuffle(rows)
    got = s.dedup(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, first string, count int")).collect()
    assert sorted(tuple(x) for x in got) == brute(rows)


def test_odd_tables(spark):
    assert s.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "xyz" * 5 + "".join(chr(97 + i * 7 % 26) for i in range(200))
    out = s.dedup(spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")).collect()
    assert len(out) == 3 and len({x.n_removed for x in out if x.doc_id == 1}) == 1
    # different texts of one id are documents of their own, in the order of their hashes
    rows = [(1, t), (1, "q" + t), (1, t + "w" * 30), (0, "v" + t[20:160]), (2, t), (1, t)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    twin = {(r.doc_id, r.text): (r.doc_id, r.twin) for r in s.told_apart(d).collect()}
    want = brute([(twin[x], x[1]) for x in dict.fromkeys(rows)])
    got = {tuple(x) for x in s.dedup(d).collect()}
    assert got == {(i[0], *rest) for i, *rest in want} and s.dedup(d).count() == 6


def test_an_owner_in_many_contexts(spark, monkeypatch):
    """One line inside many different neighbours is dealt further, with the same result."""
    monkeypatch.setattr(s, "HOT", 5)
    monkeypatch.setattr(s, "TRANSFORM", 3000)
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, near = some(60), [some(30) for _ in range(4)]
    rows = [(i, some(r.randrange(90)) + r.choice(near) + line + r.choice(near) + some(r.randrange(90))) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in s.dedup(d).collect()) == brute(rows)
    raw = rows[0][1].encode()
    for at in (0, 10, 34, 68):
        parts = list(s._dealt(raw[:168], at, min(69, at + 1)))
        assert sorted(x for _, low, n in parts for x in range(low, low + n)) == list(range(min(69, at + 1)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=120), st.integers(1, 20))
def test_expansion_is_the_common_prefix(text, n):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return
    order = s.transform(raw, n)
    got = s.expand(raw.astype(np.int64), order, n)
    cut = [text[i : i + n] for i in order]
    assert got.tolist() == [k > 0 and len(c) == n and c == cut[k - 1] for k, c in enumerate(cut)]
