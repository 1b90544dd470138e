"""Pairs of members of the same sets (users of a package, ends of steps over a node), met in a grid of bounded tasks.

A set of n members has about n * n pairs, which are not shuffled. Members are numbered in their order and dealt into
groups. A task is a cell of two groups: it gets, of every set, the members that each of them has, packed as small
numbers, so a member moves once a group of the other side and no pair moves. Cells make their pairs some at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.operators import frames
from mnemo.operators.frames import saved

#: Members that a group has in all sets together, about, pairs that a cell makes at once, and bits that it marks at once.
GROUP, CHUNK, AREA = 32_000_000, 1_000_000, 16_000_000
#: Keys of a row of names; sets that a pair is first looked for in, and the factor to the next look.
NAMES, LOOK, GROWTH = 50_000, 8, 8
PACKED = "cell int, kind int, at int, users binary, lefts binary, rights binary, left binary, right binary"
MEMBERS, LEFT, RIGHT, ASKS = range(4)


def numbered(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, number) of distinct keys but null, numbered from 0 in their order, and how many they are."""
    rows = saved(keys.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).withColumn("at", F.monotonically_increasing_id()), "numbers")
    part, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, n = [], 0
    for i in range(max(sizes, default=-1) + 1):
        starts.append(n)
        n += sizes.get(i, 0)
    return rows.select(key, (place + F.get(F.lit(starts or [0]), part)).alias("number")), n


def groups(df: DataFrame, keys: int, members: int, cells: int, block: int | None = None) -> int:
    """Groups of so many keys: at most GROUP members and `block` keys in one, and, unless members are few, about `cells` cells a core."""
    busy = min(int((cells * df.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1, -(-10 * members // frames.TASK_ROWS))
    return max(1, min(keys, max(-(-members // GROUP), busy, -(-keys // block) if block else 1)))


def _small(keys: int, r: int) -> str:
    """The type of a place in a group."""
    return "u2" if keys <= r << 16 else "u4"


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers in the least bytes."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _numbers(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"u{len(x) // n}").astype(np.int64)


def _cell(i, j, r: int, both: bool):
    """Cells of groups i and j; with `both`, of i up to j only."""
    return i * r - i * (i - 1) // 2 + j - i if both else i * r + j


def _packed(members: DataFrame, rows: int, r: int, left: str, right: str, both: bool) -> DataFrame:
    """(set, number) to rows of PACKED: of each cell, sizes and members of the sets that have some on both sides. With `both`
    a member stands on both sides, and `users` counts it even where it is null; else numbers are 2 * number + side."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in parts:
            held, n = [*held, f], n + len(f)
            if n > 4 * frames.TASK_ROWS:  # a hot set's lines repeat its members
                held = [pd.concat(held).drop_duplicates()]
                n = len(held[0])
        if not n:
            return
        f = pd.concat(held).drop_duplicates()
        code, number = pd.factorize(f["set"])[0], f["number"].fillna(-1).to_numpy(np.int64)
        number, side = (number, 0 * number) if both else np.divmod(number, 2)
        size, order = code.max() + 1, np.lexsort((number, code))
        users = np.bincount(code, minlength=size)

        def split(take: np.ndarray, kind: str) -> list:
            at = order[take[order] & (number[order] >= 0)]
            return [(code[o], (number[o] // r).astype(kind), np.bincount(code[o], minlength=size)) for o in (at[number[at] % r == g] for g in range(r))]

        a = split(side == 0, left)
        b = a if both else split(side == 1, right)
        for i, (left_code, left_place, lefts) in enumerate(a):
            out = []
            for j in range(i if both else 0, r):
                right_code, right_place, rights = b[j]
                same = both and i == j
                sets = lefts > 1 if same else (lefts > 0) & (rights > 0)
                if sets.any():
                    other = b"" if same else right_place[sets[right_code]].tobytes()
                    out.append((_cell(i, j, r, both), MEMBERS, int(sets.sum()), _bytes(users[sets]) if both else b"", _bytes(lefts[sets]), _bytes(rights[sets]), left_place[sets[left_code]].tobytes(), other))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])

    tasks = -(-rows // frames.TASK_ROWS)
    tasks = max(tasks, members.sparkSession.sparkContext.defaultParallelism) if 10 * rows > frames.TASK_ROWS else 1
    return members.select("set", "number").repartition(tasks, "set").mapInPandas(run, PACKED)


def _names(numbers: DataFrame, key: str, kind: int, r: int, both: bool) -> DataFrame:
    """The keys of each group's places, in rows of NAMES, for all cells of the group."""
    place, g, other = F.expr(f"number div {r}"), F.pmod("number", F.lit(r)).cast("int"), F.col("other")
    rows = numbers.groupBy(g.alias("g"), F.expr(f"cast(number div {r * NAMES} as int)").alias("at")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(key).alias("key")))).alias("x"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    i, j = (F.col("g"), other) if kind == LEFT else (other, F.col("g"))
    cell = i * r - F.expr(f"{'g' if kind == LEFT else 'other'} * ({'g' if kind == LEFT else 'other'} - 1) div 2") + j - i if both else i * r + j
    empty = [F.lit(None).cast("binary").alias(c) for c in ("users", "lefts", "rights", "left", "right")]
    return (rows.where(i <= j) if both else rows).select(cell.cast("int").alias("cell"), F.lit(kind).alias("kind"), "at", *empty, F.col("x.key").alias("names"))


def _held(parts: Iterator[pd.DataFrame], left: str, right: str) -> dict | None:
    """All rows of a cell: keys of both sides, sets and their members, and pairs that are asked for."""
    f = pd.concat([x for x in parts if len(x)] or [pd.DataFrame()])
    if not len(f) or not (f["kind"] == (ASKS if (f["kind"] == ASKS).any() else MEMBERS)).any():
        return None
    m, out = f[f["kind"] == MEMBERS], {"cell": int(f["cell"].iloc[0])}
    for name, kind in (("left_names", LEFT), ("right_names", RIGHT)):
        rows = f[f["kind"] == kind].sort_values("at")["names"]
        out[name] = np.concatenate([np.asarray(x) for x in rows]) if len(rows) else np.zeros(0, object)
    for c in ("users", "lefts", "rights"):
        out[c] = np.concatenate([np.zeros(0, np.int64), *(_numbers(x, n) for x, n in zip(m[c], m["at"]) if len(x))])
    # a cell of one group has its members once
    out["left"] = np.concatenate([np.zeros(0, left), *(np.frombuffer(x, left) for x in m["left"])])
    out["right"] = np.concatenate([np.zeros(0, right), *(np.frombuffer(y if len(y) else x, right) for x, y in zip(m["left"], m["right"]))])
    asks = f[f["kind"] == ASKS]
    out["asks"] = [np.concatenate([np.zeros(0, k), *(np.frombuffer(x, k) for x in asks[c])]).astype(np.int64) for c, k in (("left", left), ("right", right))]
    return out


def _runs(place: np.ndarray, count: np.ndarray, most: int, wide: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries, sorted by place, of about `most` pairs and at most so many places (wide); a place is not cut."""
    ends = np.append(np.flatnonzero(np.diff(place)) + 1, len(place)) if len(place) else np.zeros(0, int)
    total = np.cumsum(count)[ends - 1]
    at = done = 0
    while at < len(ends):
        last = max(at, int(np.searchsorted(total, done + most, "right")) - 1)
        begin = ends[at - 1] if at else 0
        last = max(at, min(last, int(np.searchsorted(place[ends - 1], int(place[begin]) + wide, "left")) - 1))
        yield int(begin), int(ends[last])
        at, done = last + 1, int(total[last])


def _members(sets: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of the members of given sets, one set after the other."""
    n = count[sets]
    return np.repeat(start[sets] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _shared(cell: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, shared, users) of a cell's pairs: in how many sets, and the users of the largest."""
    users, rights, left, right = cell["users"], cell["rights"], cell["left"], cell["right"]
    wide, bits = len(cell["right_names"]), int(users.max(initial=1)).bit_length()
    start = np.cumsum(rights) - rights
    order = np.argsort(left, kind="stable")
    sets, left = np.repeat(np.arange(len(users), dtype=np.int32), cell["lefts"])[order], left[order]
    for begin, end in _runs(left, rights[sets], CHUNK, (1 << (62 - bits)) // max(1, wide)):
        first = int(left[begin])
        count, most = np.zeros(wide if first == left[end - 1] else 0, np.int64), np.zeros(wide, np.int64)
        n = np.cumsum(rights[sets[begin:end]])
        if len(count) and n[-1] > 2 * CHUNK:  # one member with very many pairs
            for at in np.split(np.arange(begin, end), np.searchsorted(n, np.arange(CHUNK, n[-1], CHUNK))):
                other = right[_members(sets[at], start, rights)]
                count += np.bincount(other, minlength=wide)
                np.maximum.at(most, other, np.repeat(users[sets[at]], rights[sets[at]]))
            count[: first + 1 if same else 0] = 0
            b = np.flatnonzero(count)
            yield np.full(len(b), first), b, count[b], most[b]
            continue
        own = sets[begin:end]
        other, a = right[_members(own, start, rights)].astype(np.int64), np.repeat(left[begin:end].astype(np.int64), rights[own])
        pair = (((a - first) * wide + other) << bits) | np.repeat(users[own], rights[own])
        pair = np.sort(pair[a < other] if same else pair)
        last = np.append(np.flatnonzero(np.diff(pair >> bits)), len(pair) - 1) if len(pair) else np.zeros(0, int)
        a, b = np.divmod(pair[last] >> bits, wide)
        yield a + first, b, np.diff(last, prepend=-1), pair[last] & ((1 << bits) - 1)


def shared_pairs(members: DataFrame, rows: int, block: int | None = None) -> DataFrame:
    """(a, b, shared, users): pairs a < b of members of the same sets (set, member), in how many sets both are, and how
    many members the largest of these has. About so many rows; they may repeat. block: members of a group at most."""
    key = members.select("member")
    numbers, n = numbered(key, "member")
    r = groups(members, n, rows, 8, block)
    small, kind = _small(n, r), members.schema["member"].dataType.simpleString()
    own = members.where("set is not null").join(numbers, "member", "left").select("set", "number")
    packed = _packed(own, rows, r, small, small, True).withColumn("names", F.lit(None).cast(f"array<{kind}>"))
    cells = packed.union(_names(numbers, "member", LEFT, r, True)).union(_names(numbers, "member", RIGHT, r, True))
    at = {_cell(i, j, r, True): (i, j) for i in range(r) for j in range(i, r)}

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = _held(parts, small, small)
        if cell is None:
            return
        i, j = at[cell["cell"]]
        for a, b, shared, users in _shared(cell, i == j):
            up = a * r + i < b * r + j
            x, y = cell["left_names"][a], cell["right_names"][b]
            yield pd.DataFrame({"a": np.where(up, x, y), "b": np.where(up, y, x), "shared": shared, "users": users})

    return cells.repartitionById(r * (r + 1) // 2, F.col("cell")).mapInPandas(meet, f"a {kind}, b {kind}, shared long, users long")


def _untold(cell: dict) -> np.ndarray:
    """Pairs (left * width + right) that are asked for and that no set has."""
    lefts, rights, left, right = cell["lefts"], cell["rights"], cell["left"], cell["right"]
    high, wide = len(cell["left_names"]), len(cell["right_names"])
    asks = np.unique(cell["asks"][0] * wide + cell["asks"][1])
    has = lambda n, x: np.bincount(x, minlength=n).astype(bool)
    own, other = np.repeat(np.arange(len(lefts), dtype=np.int32), lefts), np.repeat(np.arange(len(lefts), dtype=np.int32), rights)
    keep = has(high, cell["asks"][0])[left]
    own, left = own[keep], left[keep]
    keep = has(wide, cell["asks"][1])[right]
    other, right = other[keep], right[keep]
    lefts, rights = np.bincount(own, minlength=len(lefts)), np.bincount(other, minlength=len(lefts))
    start, left_start = np.cumsum(rights) - rights, np.cumsum(lefts) - lefts
    pairs = lefts * rights
    for s in np.argsort(-pairs, kind="stable"):
        if pairs[s] <= 4 * (len(asks) + high + wide):
            break
        a, b = has(high, left[left_start[s] :][: lefts[s]]), has(wide, right[start[s] :][: rights[s]])
        asks = asks[~(a[asks // wide] & b[asks % wide])]  # a hub: what is asked costs less than its pairs
        pairs[s] = -1
    keep = (pairs > 0)[own]
    order = np.flatnonzero(keep)[np.argsort(left[keep], kind="stable")]
    own, left = own[order], left[order].astype(np.int64)
    turn = np.arange(len(left)) - np.searchsorted(left, left)
    low, look = 0, LOOK
    while len(asks) and low <= turn.max(initial=-1):
        e = np.flatnonzero((turn >= low) & (turn < low + look) & has(high, asks // wide)[left])
        told = np.zeros(len(asks), bool)
        for begin, end in _runs(left[e], rights[own[e]], CHUNK, max(1, AREA // max(1, wide))):
            first, last = left[e[begin]], left[e[end - 1]]
            mark = np.zeros((last - first + 1) * wide, bool)
            n = np.cumsum(rights[own[e[begin:end]]])
            for x in np.split(e[begin:end], np.searchsorted(n, np.arange(CHUNK, n[-1], CHUNK))):
                mark[np.repeat((left[x] - first) * wide, rights[own[x]]) + right[_members(own[x], start, rights)]] = True
            i, j = np.searchsorted(asks, [first * wide, (last + 1) * wide])
            told[i:j] |= mark[asks[i:j] - first * wide]
        asks = asks[~told]
        low, look = low + look, look * GROWTH
    return asks


def unmet(first: DataFrame, second: DataFrame, pairs: DataFrame, rows: int, block: int | None = None) -> DataFrame:
    """The pairs (left, right) for which no set has left in first (set, left) and right in second (set, right). About so many
    rows of both."""
    (ln, n), (rn, m) = numbered(pairs, "left"), numbered(pairs, "right")
    r = groups(pairs, max(n, m), rows // 2, 4, block)
    small, kinds = (_small(n, r), _small(m, r)), [pairs.schema[c].dataType.simpleString() for c in ("left", "right")]
    side = lambda df, numbers, key, s: df.join(numbers, key).select("set", (2 * F.col("number") + s).alias("number"))
    names = [_names(x, c, k, r, False) for x, c, k in ((ln, "left", LEFT), (rn, "right", RIGHT))]
    packed = _packed(side(first, ln, "left", 0).union(side(second, rn, "right", 1)), rows, r, *small, False)

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in parts:
            held, n = [*held, f], n + len(f)
            if n >= frames.TASK_ROWS:
                yield packed_asks(pd.concat(held))
                held, n = [], 0
        if n:
            yield packed_asks(pd.concat(held))

    def packed_asks(f: pd.DataFrame) -> pd.DataFrame:
        cell = _cell(f["i"].to_numpy() % r, f["j"].to_numpy() % r, r, False)
        order = np.argsort(cell, kind="stable")
        own, begin = np.unique(cell[order], return_index=True)
        cut = lambda c, k: [x.tobytes() for x in np.split((f[c].to_numpy()[order] // r).astype(k), begin[1:])]
        return pd.DataFrame({"cell": own, "kind": ASKS, "at": 0, "users": b"", "lefts": b"", "rights": b"", "left": cut("i", small[0]), "right": cut("j", small[1])})

    asked = pairs.join(ln.withColumnRenamed("number", "i"), "left").join(rn.withColumnRenamed("number", "j"), "right").select("i", "j").mapInPandas(ask, PACKED)

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = _held(parts, *small)
        if cell is None:
            return
        left = _untold(cell)
        for at in (left[i : i + CHUNK] for i in range(0, len(left), CHUNK)):
            a, b = np.divmod(at, len(cell["right_names"]))
            yield pd.DataFrame({"left": cell["left_names"][a], "right": cell["right_names"][b]})

    kind = "string" if kinds[0] != kinds[1] else kinds[0]
    lists = lambda df, k: df.withColumn("names", F.col("names").cast(f"array<{kind}>") if k else F.lit(None).cast(f"array<{kind}>"))
    cells = lists(packed, 0).union(lists(asked, 0)).union(lists(names[0], 1)).union(lists(names[1], 1))
    return cells.repartitionById(r * r, F.col("cell")).mapInPandas(meet, f"left {kind}, right {kind}").select(F.col("left").cast(kinds[0]).alias("left"), F.col("right").cast(kinds[1]).alias("right"))
