import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemo.llm import token_files as f
from mnemo.llm.tokens import VOCABULARY


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50256), st.integers(0, 5), st.just(2**32 - 1)), max_size=1500), st.sampled_from([1, 7, 64, 512]), st.sampled_from([2, 8192]))
def test_blocks_round_trip(ids, block, lanes):
    ids = np.array(ids, dtype=np.uint32)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(f, "BLOCK", block)
        m.setattr(f, "LANES", lanes)
        ranks, coded = f.encode_ids(ids)
        assert f.decode_ids(ranks, coded).tolist() == ids.tolist()
        for k in range(0, len(coded), 5):  # a block stands alone
            assert f.decode_ids(ranks, coded[k : k + 1]).tolist() == ids[k * block : (k + 1) * block].tolist()


def test_long_block_adapts_and_damage_shows():
    r = np.random.default_rng(1)
    words = r.integers(0, 50257, 200)
    ids = np.concatenate([words[r.integers(0, 180) :][:20] for _ in range(200)])
    ranks, coded = f.encode_ids(ids)
    assert f.decode_ids(ranks, coded).tolist() == ids.tolist()
    assert len(ranks) + sum(map(len, coded)) < 0.6 * 2 * len(ids)
    skewed = r.choice(words, 20000, p=np.arange(200) ** 4 / (np.arange(200) ** 4).sum())
    p = np.bincount(skewed)[np.bincount(skewed) > 0] / len(skewed)
    ranks, coded = f.encode_ids(skewed)
    assert sum(len(c) - 12 for c in coded) * 8 < 1.12 * -(p * np.log2(p)).sum() * len(skewed)  # near the order-0 entropy
    for at in (0, 5, 40, len(coded[1]) - 1):
        bad = bytearray(coded[1])
        bad[at] ^= 8
        with pytest.raises(ValueError, match="block 1"):
            f.decode_ids(ranks, [coded[0], bytes(bad)])


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(f, "SEGMENT", 500)
    monkeypatch.setattr(f, "BLOCK", 64)
    rows = [(i, f"the {i} hills and rivers " * (i % 5), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "far " * 3000, "x"), (7, "a", "x"), (7, "a", "x"), (None, "n", "x")]
    out = f.through_files(spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)).collect()
    assert len(out) == len(rows)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    plain = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want = sorted((-1 if i is None else i, zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in out) == want
    assert f.through_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0
