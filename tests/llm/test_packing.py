import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemo.llm import packing as p
from mnemo.llm import tokens
from mnemo.llm.tokens import VOCABULARY, encoder


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_each_token_once_and_no_gaps(lengths):
    pieces, seqs = p.pack(lengths), {}
    for d, n in enumerate(lengths):
        own = sorted((s, m) for x, s, m, _, _ in pieces if x == d)
        assert own[0][0] == 0 and sum(m for _, m in own) == n
        assert all(a + m == b for (a, m), (b, _) in zip(own, own[1:]))
    for _, _, m, q, o in pieces:
        seqs.setdefault(q, []).append((o, m))
    for own in seqs.values():
        own.sort()
        assert own[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(own, own[1:])) and sum(m for _, m in own) <= p.CAPACITY
    assert len(seqs) == -(-sum(lengths) // p.CAPACITY)


def test_padding():
    assert [p.padded(n) for n in (1, 2, 3, 512, 513, 1024)] == [1, 2, 4, 512, 1024, 1024]


texts = st.lists(st.sampled_from([*"ab Zé\n\t'.,0\0漢<|>", "  ", "   ", "<|endoftext|>", " \n "]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_are_the_tokenizers(text):
    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    for as_text in (False, True):
        t.encode_special_tokens = as_text
        for _ in range(2):  # with and without the remembered chunks
            ids, counts = encoder(specials_as_text=as_text).encode(pa.array([None, text, "a", text]))
            own, a = (t.encode(x, add_special_tokens=False).ids for x in (text, "a"))
            assert ids.tolist() == [*own, *a, *own]
            assert counts.tolist() == [0, len(own), len(a), len(own)]


def test_groups_and_long_chunks_give_the_same_ids(monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    rows = ["x" * 500 + f" {i} " + "漢字" * 90 + f" river {i}, hills. " * i for i in range(40)] * 2
    rows[3:5] = ["", None]
    want = [i for x in rows for i in t.encode(x or "", add_special_tokens=False).ids]
    for together, remembered in ((1, 5), (3000, 100), (8_000_000, 1_000_000)):
        monkeypatch.setattr(tokens, "TOGETHER", together)
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        monkeypatch.setattr(tokens, "SLICE", together)
        batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(range(len(rows)))], names=["text", "i"])
        cut = [*tokens.slices([batch.slice(2), batch.slice(0, 0), batch])]
        assert [i for b in cut for i in b.column("i").to_pylist()] == [*range(2, len(rows)), *range(len(rows))]
        e = tokens.Encoder(public_tokenizers.path(VOCABULARY))
        assert e.encode(pa.array(rows).slice(1))[0].tolist() == [i for x in rows[1:] for i in t.encode(x or "", add_special_tokens=False).ids]
        assert e.encode(pa.array(rows, pa.large_string()))[0].tolist() == want
        assert [x.tolist() for x in e.encode(pa.array(["", None]))] == [[], [0, 0]] and e.encode(pa.array([], pa.string()))[1].tolist() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=200))
def test_lowest_cost_with_room(lengths):
    """Against all sequences tried one by one: a document is cut only where none has room for all of it."""
    rest = sorted([-(n % p.CAPACITY), d, n - n % p.CAPACITY] for d, n in enumerate(lengths) if n % p.CAPACITY)
    first = sum(n // p.CAPACITY for n in lengths)
    free = {first + k: (0.0, p.CAPACITY) for k in range(-(sum(r[0] for r in rest) // p.CAPACITY))}
    want = []
    while rest:
        n, d, start = rest.pop(0)
        fits = [(c, q) for q, (c, room) in free.items() if room >= -n]
        spent, q = min(fits or [(c, q) for q, (c, room) in free.items() if room])
        put = min(-n, free[q][1])
        want.append((d, start, put, q, p.CAPACITY - free[q][1]))
        free[q] = (spent + p.cost(put), free[q][1] - put)
        if put < -n:
            rest = sorted([*rest, [n + put, d, start + put]])
    assert [x for x in p.pack(lengths) if x[2] < p.CAPACITY] == want


def test_table(spark):
    rows = [(1, "a b c", 9), (2, None, 9), (3, "", 9), (4, "word " * 4000, 9), (4, "word " * 4000, 9), (None, "x", 9)]
    out = p.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, offset int")).collect()
    assert sum(r.length for r in out if r.doc_id == 4) == 2 * next(r.doc_tokens for r in out if r.doc_id == 4)
    assert [(r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 2] == [(0, 1, zlib.crc32(b"\0\0\0\0"))]
    assert {r.doc_id for r in out} == {1, 2, 3, 4, None}
    plain = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    for i, text, _ in rows:  # each piece holds the ids that it says
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for r in out:
            if r.doc_id == i:
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    assert p.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
