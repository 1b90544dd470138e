"""Conversation prefix trie from sorted neighbours.

Conversations are sorted by the digests of their turns. The longest common prefixes of neighbours are
edges; union-find over them in descending depth builds a forest: each merge of two components makes a
branching node (or joins one of that depth). A run of rows keeps its forest except for the two spines,
the prefixes of its first and last row, onto which everything beside them is contracted as counts. Runs
are then merged across their boundaries, some at a time and level by level: the spines of neighbours are
united as deep as they agree, in descending depth, what lies beside the new outer spines is final, and
the rest is the contracted forest of the merged run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import saved
from mnemo.llm.sharding import _BYTES, _crc_table

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns of a run at most (one conversation at least), runs merged at a time, ids of a chunk, salts of the join with shared parents.
RUN, MERGE, CHUNK, SALTS = 100_000, 64, 10_000, 32
NONE_SHA = hashlib.sha256(b"").hexdigest()

#: kind 0: a final node; 1: a final node whose ends are told by chunks (id: its identity); 2: a contracted run; 3: a chunk of ends.
OUT = "kind int, at long, id string, conv_id long, depth long, parent string, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, text string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def shared_prefix(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    n, d = min(len(a), len(b)) // WIDTH, 0
    while d < n and a[d * WIDTH : d * WIDTH + WIDTH] == b[d * WIDTH : d * WIDTH + WIDTH]:
        d += 1
    return d


def identities(key: bytes) -> list[str]:
    """A name for each prefix of a key, the empty one first."""
    h, out = hashlib.sha256(), []
    out.append(h.hexdigest()[:32])
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.hexdigest()[:32])
    return out


class Roots:
    """Union-find; the smaller number stays the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a > b:
            a, b = b, a
        self.up[b] = a
        return a


def forest(depths: list[int], edges: list[int]) -> tuple[list[int], list[int]]:
    """(depth, parent) of the nodes over sorted distinct leaves and the prefixes that neighbours share. Leaves
    come first. A leaf that is a prefix of its successors is itself the branching node; the last node has parent -1."""
    depth, parent = list(depths), [-1] * len(depths)
    sets, top = Roots(len(depths)), list(range(len(depths)))
    for e in sorted(range(len(edges)), key=lambda i: -edges[i]):  # stable: left to right within a depth
        a, b = top[sets.find(e)], top[sets.find(e + 1)]
        if depth[a] != edges[e]:
            depth.append(edges[e])
            parent.append(-1)
            parent[a] = len(depth) - 1
            a = len(depth) - 1
        parent[b] = a
        top[sets.join(e, e + 1)] = a
    return depth, parent


class Path:
    """What hangs on each depth of a spine beside the spine: conversations, the least id, children, leaves, saved."""

    def __init__(self, key: bytes, lens: list[int], facts: list[list] | None = None):
        self.key, self.lens = key, lens
        self.facts = facts or [[0, None, 0, 0, 0] for _ in range(len(lens) + 1)]


def _add(to: list, n: int, least: int | None, kids: int, leaves: int, saved_tokens: int) -> None:
    to[0] += n
    to[1] = least if to[1] is None or (least is not None and least < to[1]) else to[1]
    to[2] += kids
    to[3] += leaves
    to[4] += saved_tokens


def pack(first: Path, last: Path) -> str:
    return json.dumps([[p.key.hex(), p.lens, p.facts] for p in (first, last)])


def unpack(text: str) -> tuple[Path, Path]:
    return tuple(Path(bytes.fromhex(k), lens, facts) for k, lens, facts in json.loads(text))


def contract(keys: list[bytes], ids: list[int], lens: list[list[int]]) -> tuple[list[tuple], list[tuple], tuple[Path, Path]]:
    """The forest of a run: (final nodes, chunks of ends that may go on outside, spines)."""
    heads = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    ends = [*heads[1:], len(keys)]
    leaf = [keys[i] for i in heads]
    edges = [shared_prefix(a, b) for a, b in zip(leaf, leaf[1:], strict=False)]
    depth, parent = forest([len(k) // WIDTH for k in leaf], edges)
    n, total = len(leaf), len(depth)
    facts = [[ends[v] - heads[v], ids[heads[v]], 0, 0, 0] if v < n else [0, None, 0, 0, 0] for v in range(total)]
    rep = list(range(total))
    first, last = Path(leaf[0], lens[heads[0]]), Path(leaf[-1], lens[heads[-1]])
    both = shared_prefix(first.key, last.key)
    side: dict[int, Path] = {}
    for p, v in ((last, n - 1), (first, 0)):
        while v >= 0:
            side[v] = p if depth[v] > both else first
            rep[v], v = 0 if p is first else n - 1, parent[v]
    order = sorted(range(total), key=lambda v: -depth[v])
    saving: dict[int, list[int]] = {}
    for v in order:
        if v in side:
            _add(side[v].facts[depth[v]], *facts[v])
            continue
        count, least, kids, leaves, below = facts[v]
        u = parent[v]
        rep[u] = rep[v] if u not in side and u >= n else rep[u]
        run, one = below, lens[heads[rep[v]]]
        saving[v] = []
        for d in range(depth[v], depth[u], -1):
            run += (count - 1) * one[d - 1]
            saving[v].append(run)
        facts[v][3] = leaves if kids else 1
        _add(facts[u] if u not in side else side[u].facts[depth[u]], count, least, 1, facts[v][3], run)
    names = {id(p): identities(p.key) for p in (first, last)}
    nodes = []
    for v, runs in saving.items():
        count, least, kids, leaves, _ = facts[v]
        u = parent[v]
        if u in side:
            above = (names[id(side[u])][depth[u]], None)
        else:
            above = (None, facts[u][1])
        digest = hashlib.sha256(",".join(map(str, ids[heads[v] : ends[v]])).encode()).hexdigest() if v < n else NONE_SHA
        for k, run in enumerate(runs):
            d = depth[v] - k
            up = above if d == depth[u] + 1 else (None, least)
            nodes.append((0, None, None, least, d, *up, count, 1 if k else kids, leaves, run, NONE_SHA if k else digest, None))
    chunks = []
    for v, p in ((v, p) for v, p in side.items() if v < n):
        for at in range(heads[v], ends[v], CHUNK):
            part = ids[at : min(at + CHUNK, ends[v])]
            chunks.append((3, None, names[id(p)][depth[v]], part[0], depth[v], None, None, None, None, None, None, None, ",".join(map(str, part))))
    return nodes, chunks, (first, last)


def merge(runs: list[tuple[Path, Path]], close: bool = False) -> tuple[list[tuple], tuple[Path, Path]]:
    """(final nodes, spines) of neighbouring runs; with close, the spines' nodes are final too."""
    paths, number, facts, up, tokens, name, deep = [], {}, [], [], [], [], []

    def node(path: Path, d: int, above: int, names: list[str]) -> int:
        facts.append([0, None, 0, 0, 0])
        up.append(above)
        tokens.append(path.lens[d - 1] if d else 0)
        name.append(names[d])
        deep.append(d)
        return len(facts) - 1

    for first, last in runs:
        both, mine = shared_prefix(first.key, last.key), []
        for side, path in enumerate((first, last)):
            names, at = identities(path.key), []
            for d in range(len(path.lens) + 1):
                at.append(mine[0][d] if side and d <= both else node(path, d, at[-1] if at else -1, names))
                _add(facts[at[-1]], *path.facts[d])
            mine.append(at)
        paths.append(mine)
    sets = Roots(len(facts))
    edges = [(shared_prefix(a[1].key, b[0].key), i) for i, (a, b) in enumerate(zip(runs, runs[1:], strict=False))]
    for depth, i in sorted(edges, key=lambda e: (-e[0], e[1])):
        for d in range(depth, -1, -1):
            a, b = sets.find(paths[i][1][d]), sets.find(paths[i + 1][0][d])
            if a == b:
                break  # all above is united too
            top = sets.join(a, b)
            _add(facts[top], *facts[b if top == a else a])
    outer = [[sets.find(v) for v in paths[0][0]], [sets.find(v) for v in paths[-1][1]]]
    kept = set() if close else {*outer[0], *outer[1]}
    final, found = [], {}
    for v in sorted((v for v in range(len(facts)) if sets.up[v] == v), key=lambda v: -deep[v]):
        if v in kept:
            continue
        count, least, kids, leaves, below = facts[v]
        leaves, run, u = leaves if kids else 1, below + (count - 1) * tokens[v], sets.find(up[v]) if up[v] >= 0 else None
        if u is not None:
            _add(facts[u], count, least, 1, leaves, run)
        found[v] = (u, count, kids, leaves, run)
    for v, (u, count, kids, leaves, run) in found.items():
        final.append((1, None, name[v], facts[v][1], deep[v], name[u] if u is not None and u in kept else None, facts[u][1] if u is not None and u not in kept else None, count, kids, leaves, run, None, None))
    first, last = Path(runs[0][0].key, runs[0][0].lens), Path(runs[-1][1].key, runs[-1][1].lens)
    if not close:
        taken: set[int] = set()
        for path, at in ((first, outer[0]), (last, outer[1])):
            for d, v in enumerate(at):
                if v not in taken:
                    taken.add(v)
                    path.facts[d] = facts[v]
    return final, (first, last)


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition in order to final nodes, chunks, and one contracted run."""
    at, whole = TaskContext.get().partitionId(), []
    keys, ids, lens, size = [], [], [], 0

    def cut(some: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(some, columns=COLUMNS, dtype=object).assign(at=at)  # whole numbers beside nulls stay whole

    for f in frames:
        for key, conv, ns in zip(f["key"], f["conv_id"], f["lens"], strict=True):
            keys.append(key)
            ids.append(int(conv))
            lens.append(ns.tolist())
            size += 1 + len(ns)
            if size >= RUN:
                nodes, chunks, spines = contract(keys, ids, lens)
                whole.append(spines)
                yield cut(nodes + chunks)
                keys, ids, lens, size = [], [], [], 0
                if len(whole) >= MERGE:
                    nodes, spines = merge(whole)
                    whole = [spines]
                    yield cut(nodes)
    if keys:
        nodes, chunks, spines = contract(keys, ids, lens)
        whole.append(spines)
        yield cut(nodes + chunks)
    if whole:
        nodes, spines = merge(whole)
        yield cut([*nodes, (2, *[None] * (len(COLUMNS) - 2), pack(*spines))])


def _merging(close: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        nodes, spines = merge([unpack(t) for t in f.sort_values("at")["text"]], close)
        return pd.DataFrame(nodes + ([] if close else [(2, *[None] * (len(COLUMNS) - 2), pack(*spines))]), columns=COLUMNS, dtype=object).assign(at=int(f["at"].min()) // MERGE)

    return run


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the chunks of each node, which come in order; the state is one hash."""
    node, h = None, None
    for f in frames:
        out = []
        for one, text in zip(f["id"], f["text"], strict=True):
            if one != node:
                if node is not None:
                    out.append((node, h.hexdigest()))
                node, h = one, hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.encode())
        yield pd.DataFrame(out, columns=["id", "ends"])
    if node is not None:
        yield pd.DataFrame([(node, h.hexdigest())], columns=["id", "ends"])


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, key, lens): conversation c as the first h turns of c - c % group, then its own after its first h,
    h = crc32(decimal c) % (most + 1), at most the other's turns. key has WIDTH bytes a turn, lens its code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turn = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.length(text).alias("n"))
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    start = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(start, "base", "left").withColumn("h", h)
    none = F.slice("own", 1, 0)
    turns = F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), none), F.slice("own", F.col("h") + 1, F.size("own")))
    return both.select("conv_id", turns.alias("t")).select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("key"), F.col("t.n").alias("lens"))


def trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of sequences (conv_id, key, lens), one row a distinct prefix.

    Every task holds a run of RUN turns, or MERGE pairs of spines. A sequence is one row: WIDTH + 4 bytes a turn
    must fit a row. The ids that end at one node are hashed in order, chunk by chunk, which only one task can do."""
    spark = sequences.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = sequences.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    low = saved(ordered.mapInPandas(_runs, OUT), "trie")
    runs, inner = low.where("kind = 2"), low.where("kind = 1")
    most = runs.agg(F.max("at")).head()[0]
    while most is not None:
        close = most < MERGE
        level = saved(runs.groupBy((F.col("at") / MERGE).cast("long").alias("_g")).applyInPandas(_merging(close), OUT), "trie-merge")
        inner = inner.unionByName(level.where("kind = 1"))
        runs, most = level.where("kind = 2"), None if close else most // MERGE
    chunks = low.where("kind = 3").select("id", "conv_id", "text").repartition(parts, "id").sortWithinPartitions("id", "conv_id")
    ends = chunks.mapInPandas(_digests, "id string, ends string")
    facts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = inner.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    mid = inner.join(above, "parent", "left").join(ends, "id", "left").select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NONE_SHA)).alias("ends_sha256"))
    done = low.where("kind = 0")
    salted = above.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    hung = done.where("parent IS NOT NULL").drop("parent_conv_id").withColumn("salt", F.pmod("conv_id", F.lit(SALTS)).cast("int")).join(salted, ["parent", "salt"]).withColumnRenamed("above", "parent_conv_id")
    return done.where("parent IS NULL").select(*facts).unionByName(hung.select(*facts)).unionByName(mid)


def describe(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations (rebuilt): conv_id (least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    Rows without conv_id belong to no conversation; null turns come first; null roles and texts are empty;
    turns of equal number are ordered by the digest of role and text; repeated rows are turns of their own;
    an empty table has no nodes, not even a root; other columns are not read."""
    return trie(saved(rebuilt(conversations), "conversations"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS g
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g, n) AS r FROM t),
i AS (SELECT conv_id, conv_id::VARCHAR AS t, hex(encode(conv_id::VARCHAR)) AS h FROM o GROUP BY conv_id),
tab AS (SELECT [{_crc_table()}]::BIGINT[] AS tab),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS b,
    xor(list_reduce({_BYTES}, lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM i, tab),
s AS (SELECT c.conv_id, 0 AS part, r, g, n FROM c JOIN o ON o.conv_id = c.b AND o.r <= c.h
  UNION ALL SELECT c.conv_id, 1, r, g, n FROM c JOIN o ON o.conv_id = c.conv_id AND o.r > c.h),
q AS (SELECT c.conv_id, coalesce(gs, []) AS gs, coalesce(ns, []) AS ns FROM c LEFT JOIN
  (SELECT conv_id, list(g ORDER BY part, r) AS gs, list(n ORDER BY part, r) AS ns FROM s GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, d, array_to_string(gs[1:d], '') AS k, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(gs) AS e FROM q, LATERAL (SELECT unnest(range(0, len(gs) + 1)) AS d)),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE e), '') AS ends FROM p GROUP BY d, k),
kid AS (SELECT d - 1 AS d, substr(k, 1, 32 * (d - 1)) AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid USING (d, k)),
above AS (SELECT a AS d, substr(k, 1, 32 * a) AS k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
  FROM full_node, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY 1, 2)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_node x JOIN above ON above.d = x.d AND above.k = x.k LEFT JOIN node y ON x.d > 0 AND y.d = x.d - 1 AND y.k = substr(x.k, 1, 32 * (x.d - 1))"""
