import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemo.llm import matroska as m


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 700), st.integers(0, 255))
def test_round_trip(frames, seed):
    payload = bytes((i * 7 + seed) % 256 for i in range(frames * m.FRAME))
    data = m.write(payload)
    packets, cues, clusters, tracks = m.parse(data)
    assert [x[1] for x in packets] == [24 * k for k in range(frames)]
    assert tracks == [{"number": 1, "kind": 2, "duration": 24_000_000, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "depth": 8}]
    assert b"".join(data[a : a + n] for _, _, a, n, _ in packets) == payload
    assert len(cues) == clusters == -(-frames // (m.LACE * m.BLOCKS))
    assert all(data[at : at + 4] == m.CLUSTER.to_bytes(4, "big") for _, _, at in cues)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=2, max_size=9), st.sampled_from([1, 3]), st.booleans())
def test_uneven_laces(sizes, kind, unknown):
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    block = m.element(m.GROUP, m.element(m.BLOCK, b"\x82\x00\x05" + bytes([kind << 1]) + m._laced(frames, kind)))
    cluster = m.number(m.TIMESTAMP, 100) + block
    head = m.element(m.EBML, m.element(m.DOCTYPE, b"matroska"))
    tail = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster if unknown else m.element(m.CLUSTER, cluster)
    data = head + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + tail
    packets, _, _, _ = m.parse(data)
    assert [data[a : a + n] for _, _, a, n, _ in packets] == frames
    assert {(t, ts) for t, ts, *_ in packets} == {(2, 105)}


def test_damage():
    with pytest.raises(ValueError):
        m.parse(b"RIFF")
    with pytest.raises(ValueError):
        m.parse(m.write(b" " * 384)[:-300])


def test_key_frames_of_groups():
    def group(*parts):
        return m.element(m.GROUP, b"".join(parts))

    block, refers = m.element(m.BLOCK, b"\x81\x00\x01\x00ab"), m.element(m.REFERENCE, b"\xff")
    head = m.element(m.EBML, m.element(m.DOCTYPE, b"matroska"))
    simple = [m.element(m.SIMPLE, b"\x81\x00\x02" + bytes([f]) + b"c") for f in (0x80, 0)]
    data = head + m.element(m.SEGMENT, m.number(m.SCALE, 1_000_001) + m.element(m.CLUSTER, m.number(m.TIMESTAMP, 3) + group(block) + group(block, refers) + group(refers, block) + b"".join(simple)))
    assert [p[4] for p in m.parse(data)[0]] == [True, False, False, True, False]
    assert [p[1] for p in m.parse(data, 1)[0]] == [4 * 1_000_001] * 3 + [5 * 1_000_001] * 2


def test_table(spark):
    rows = [(1, "é" * 100, 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "x" * 100_000, 5)]
    media = m.to_media(spark.createDataFrame(rows, "doc_id long, text string, media int"))
    out = {r.doc_id: r for r in m.describe(media).collect()}
    want = ("é" * 100).encode().ljust(384)
    assert (out[1].n_bytes, out[1].payload_bytes, out[1].payload_sha256) == (200, 384, hashlib.sha256(want).hexdigest())
    assert (out[2].n_bytes, out[2].payload_bytes) == (0, 192) and out[None].payload_bytes == 100_032
    assert m.packet_table(media).count() == 2 + 1 + 1 + 1 + 521
    assert {(r.codec, r.rate, r.depth) for r in m.track_table(media).collect()} == {("A_PCM/INT/LIT", 8000.0, 8)} and m.track_table(media).count() == 5
    damaged = spark.createDataFrame([(1, b"RIFF", 0), (2, None, 0), (3, b"", 0)], "doc_id long, media binary, track int")
    assert [(r.doc_id, r.error) for r in m.damaged(damaged).collect()] == [(1, "not an EBML file")] and m.damaged(media).count() == 0
    digests = {(r.doc_id, r.packet): r for r in m.packet_digests(media.where("doc_id in (1, 2)")).collect()}
    assert [digests[k].packet_sha256 for k in ((1, 0), (1, 1), (2, 0))] == [hashlib.sha256(x).hexdigest() for x in (want[:192], want[192:], b" " * 192)]
    assert (len(digests), digests[1, 1].timestamp_ns, digests[1, 1].keyframe) == (3, 24_000_000, True)
    assert m.packet_table(damaged).count() == 0 and m.track_table(damaged).count() == 0
    for i, text, _ in rows:  # every column against a plain computation
        raw = (text or "").encode()
        raw = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        n, stored = len(raw) // 192, m.write(raw)
        mean, peak = sum(raw) * 1000 // len(raw), max(raw)
        assert out[i].tail_crc32 == zlib.crc32(raw[-16:]) and out[i].media_sha256 == hashlib.sha256(stored).hexdigest() and out[i].media_bytes == len(stored)
        assert out[i].feature == f"codec=A_PCM/INT/LIT;packets={n};clusters={-(-n // 256)};cues={-(-n // 256)};end_ms={24 * n};mean={mean};peak={peak}"
    assert m.describe(m.to_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
