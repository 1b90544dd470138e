import hashlib
import random
import zlib

from mnemo.llm import prefix_trie as pt


def brute(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]

    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, digest(role, text), role, text))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    seq = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids, leaves, saving = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saving[p[:d]] = saving.get(p[:d], 0) + (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saving[p], ends[p]) for p, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def sample(rng, n, deep, words):
    rows = []
    for c in rng.sample(range(5 * n), n):
        for t in range(rng.randrange(1, deep)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "system", "x" * rng.choice(words)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, lens string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "l") for r in rows], SCHEMA).repartition(3)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = sample(rng, 150, 7, [1, 1, 1, 2, 3])
    rows += [(10_001 + i, t, "user", "copy") for i in range(300) for t in range(9)]  # most conversations are copies
    rows += [(7, None, None, None), (7, None, "user", None), (None, 1, "user", "no conversation"), (9_000, 1, None, ""), (9_000, 1, None, "")]
    rows += [(20_000, 0, "user", "a"), (20_000, 1, "user", "a"), (20_001, 0, "b", "c"), (20_105, 3, "é", "😀" * 500)]
    assert rows_of(pt.describe(frame(spark, rows))) == brute(rows)


def test_boundaries_of_runs_and_levels():
    """Runs of any cut, merged by twos and threes, give the forest of the whole."""
    rng = random.Random(9)
    for _ in range(300):
        seqs = sorted((b"".join(bytes([rng.choice(b"abc")]) * pt.WIDTH for _ in range(rng.randrange(0, 6))), c) for c in range(rng.randrange(1, 25)))
        runs, nodes, chunks, at = [], [], {}, 0
        while at < len(seqs):
            part = seqs[at : at + rng.randrange(1, 6)]
            at += len(part)
            done, some, spines = pt.contract([k for k, _ in part], [c for _, c in part], [[5] * (len(k) // pt.WIDTH) for k, _ in part])
            nodes += done
            for ch in some:
                chunks.setdefault(ch[2], []).append((ch[3], ch[-1]))
            runs.append(pt.unpack(pt.pack(*spines)))
        while len(runs) > 1:
            g = rng.randrange(2, 4)
            merged = [pt.merge(runs[i : i + g]) for i in range(0, len(runs), g)]
            nodes += [x for m in merged for x in m[0]]
            runs = [m[1] for m in merged]
        nodes += pt.merge(runs, close=True)[0]
        members = {}
        for k, c in seqs:
            for d in range(len(k) // pt.WIDTH + 1):
                members.setdefault(k[: d * pt.WIDTH], []).append((c, len(k)))
        name = {x[2]: x[3] for x in nodes if x[0] == 1}
        got = sorted((x[3], x[4], -1 if not x[4] else x[6] if x[6] is not None else name[x[5]], x[7], x[8], x[9], x[10]) for x in nodes)
        kids = lambda p: [q for q in members if len(q) == len(p) + pt.WIDTH and q.startswith(p)]
        under = lambda p: [q for q in members if q.startswith(p)]
        low = lambda p: min(c for c, _ in members[p])
        assert got == sorted(
            (low(p), len(p) // pt.WIDTH, low(p[: -pt.WIDTH]) if p else -1, len(m), len(kids(p)), sum(not kids(q) for q in under(p)), sum((len(members[q]) - 1) * 5 for q in under(p) if q)) for p, m in members.items()
        )
        for key, ids in chunks.items():
            p = next(q for q in members if pt.identities(q)[-1] == key)
            assert ",".join(t for _, t in sorted(ids)) == ",".join(str(c) for c, n in sorted(members[p]) if n == len(p))


def test_many_runs_and_partitions(spark, monkeypatch):
    rows = sample(random.Random(1), 400, 6, [1, 1, 2])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        assert rows_of(pt.describe(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_and_single(spark):
    assert pt.describe(frame(spark, [(None, 1, "a", "b")])).collect() == []
    rows = [(105, 1, "user", "hi")]
    assert rows_of(pt.describe(frame(spark, rows))) == brute(rows)
