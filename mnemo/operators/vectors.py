"""Vector search on inverted lists with exact pruning.

A coarse quantizer is fitted on a bounded sample; every vector goes to the list of its nearest centre and
keeps its part along the centre's direction and across it. For a query q split the same way,
q . x <= q_along * x_along + |q_across| * |x_across| (on unit vectors this is the triangle inequality of
angles), so lists that cannot reach a query's k-th best are never compared. Results are those of brute
force: recall is 1. Near lists share a shelf of a block of rows, and shelves meet queries by an equi-join on
(shelf, blocks of both), so a hot list is dealt over as many tasks as it has blocks and a vector moves once a
block of the other side; inside a pair of blocks numpy multiplies matrices in single precision and only what
may be a hit by the error's bound is computed in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.operators.frames import saved, top

#: Rows of the sample that centres are fitted on, lists at most, rows of a block of items or queries, rounds of the fit.
SAMPLE, LISTS, BLOCK, ROUNDS = 20_000, 1024, 16_000, 6
#: Rows of both sides of one matrix product, and tasks of a comparison at most.
TILE, TASKS = 4_000, 4_096
#: Rows of probes that a task makes at once.
PROBE_ROWS = 20_000
_EPS = 1e-5


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def fit_centres(x: np.ndarray, k: int) -> np.ndarray:
    """k unit directions by a few rounds of spherical k-means; the start is spread evenly over the sample."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        for j in range(k):
            own = x[near == j]
            if len(own) and np.linalg.norm(s := own.sum(axis=0)) > 0:
                c[j] = s / np.linalg.norm(s)
    n = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(n > 0, c / np.where(n > 0, n, 1), np.eye(1, x.shape[1]))


def chain(c: np.ndarray) -> np.ndarray:
    """An order in which each direction is followed by the nearest of the rest."""
    like, order = c @ c.T, [0]
    like[:, 0] = -np.inf
    while len(order) < len(c):
        order.append(int(like[order[-1]].argmax()))
        like[:, order[-1]] = -np.inf
    return np.array(order)


def shelves(counts: np.ndarray, block: int) -> np.ndarray:
    """The shelf of each list: following lists of a block of rows together; a longer list has a shelf to itself."""
    out, at, rows = [], 0, 0
    for n in counts:
        if rows and rows + n > block:
            at, rows = at + 1, 0
        out.append(at)
        rows += n
    return np.array(out, dtype=int)


def split(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of rows x along directions c (one each, or all) and the lengths of what is across."""
    along = x @ c.T
    return along, np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] - along**2))


class VectorIndex:
    """Inverted lists over every row of items (id, vector).

    lists: (id, vector, list, along, across, shelf, block). box: per list the least and greatest part along, the
    greatest across and the number of rows; with the centres it is all that tasks get (LISTS rows at most)."""

    def __init__(self, lists: DataFrame, centres: np.ndarray, box: np.ndarray, unit: bool, block: int = BLOCK):
        self.lists, self.centres, self.box, self.unit, self.block = lists, centres, box, unit, block
        self.shelf = shelves(box[:, 3], block)
        self.shelved = np.bincount(self.shelf, box[:, 3]) if len(box) else np.zeros(0)

    @staticmethod
    def build(items: DataFrame, unit: bool = True, k: int | None = None, block: int = BLOCK) -> VectorIndex:
        """Null vectors and those of another length than most of the sample are left out; unit False compares
        by cosine, which makes unit vectors of all but zero ones. A pair of blocks has block * block products at most."""
        vectors = items.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull()))
        sample = vectors.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(SAMPLE).toPandas()
        id_type = items.schema["id"].dataType.simpleString()
        schema = f"id {id_type}, vector array<double>, list int, along double, across double"
        if not len(sample):
            return VectorIndex(items.sparkSession.createDataFrame([], schema + ", shelf int, block int"), np.zeros((0, 0)), np.zeros((0, 4)), unit, block)
        dim = int(sample["vector"].map(len).mode()[0])
        x = _rows(sample["vector"][sample["vector"].map(len) == dim])
        n = len(sample) if len(sample) < SAMPLE else vectors.count()
        centres = fit_centres(x, min(len(x), k or max(1, min(LISTS, int(n**0.5) // 8))))
        centres = centres[chain(centres)]

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = _unit(_rows(f["vector"])) if not unit else _rows(f["vector"])
                    along, across = split(x, centres)
                    own = along.argmax(axis=1)
                    at = np.arange(len(f))
                    yield pd.DataFrame({"id": f["id"], "vector": pd.Series(list(x), dtype=object), "list": own, "along": along[at, own], "across": across[at, own]})

        lists = saved(vectors.where(F.size("vector") == dim).mapInPandas(deal, schema), "lists")
        box = np.zeros((len(centres), 4))
        for r in lists.groupBy("list").agg(F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("wide"), F.count("*").alias("n")).collect():
            box[r["list"]] = r.low, r.high, r.wide, r.n
        index = VectorIndex(None, centres, box, unit, block)
        index.lists = lists.withColumn("shelf", F.get(F.lit(index.shelf.tolist()), F.col("list"))).withColumn("block", _block("id", "shelf", index.shelved, block))
        return index

    @staticmethod
    def plain(items: DataFrame, block: int = BLOCK) -> VectorIndex:
        """All rows in one list whose bound everything passes: nothing is fitted, dealt or saved. For few queries. Null
        vectors, those with a part that is null or no number and those of another length than most are left out."""
        vectors = items.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v)))
        sizes = vectors.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").head()
        dim, n = (sizes.dim, sizes.n) if sizes else (0, 0)
        index = VectorIndex(None, np.zeros((min(n, 1), dim)), np.array([[0, 0, 1e150, n]])[: min(n, 1)], True, block)
        zero = lambda kind: F.lit(0).cast(kind)
        place = _block("id", "shelf", index.shelved, block) if n else zero("int")
        rows = vectors.where(F.size("vector") == dim).withColumns({"list": zero("int"), "along": zero("double"), "across": zero("double"), "shelf": zero("int")})
        index.lists = rows.withColumn("block", place)
        return index

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(query, list): no member of the list is more alike than this."""
        along, across = split(q, self.centres)
        low, high, wide, n = self.box.T
        return np.where(n > 0, np.maximum(along * low, along * high) + across * wide, -np.inf)

    def _probes(self, queries: DataFrame, own: bool | None = None) -> DataFrame:
        """queries (query, vector, floor) to (query, vector, floor, shelf): the shelf of the best list (own), or all
        others, or all, with a list that may reach the floor."""
        me = VectorIndex(None, self.centres, self.box, self.unit, self.block)
        schema = f"query {queries.schema['query'].dataType.simpleString()}, vector array<double>, floor double, shelf int"
        step = max(1, PROBE_ROWS // max(1, len(self.centres)))
        starts = np.flatnonzero(np.diff(self.shelf, prepend=-1)) if len(self.shelf) else None

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for f in (whole[i : i + step] for i in range(0, len(whole), step)):  # a query makes a row a shelf
                    b = np.maximum.reduceat(me.bounds(_rows(f["vector"])), starts, axis=1)
                    best = np.zeros(b.shape, bool)
                    best[np.arange(len(f)), b.argmax(axis=1)] = True
                    may = (b >= f["floor"].to_numpy()[:, None] - _EPS) & np.isfinite(b)
                    row, at = np.nonzero(may if own is None else may & (best == own))
                    yield pd.DataFrame({"query": f["query"].to_numpy()[row], "vector": pd.Series([f["vector"].iloc[i] for i in row], dtype=object), "floor": f["floor"].to_numpy()[row], "shelf": at})

        return queries.mapInPandas(run, schema)

    def _compare(self, probes: DataFrame, k: int | None, digits: int, same: str) -> DataFrame:
        """Probes meet their shelves: (query, id, similarity) at or over their floor; k best of each block if k is given.
        same: 'skip' leaves out rows of the query's own id, 'below' takes smaller ids only, 'keep' all."""
        if not len(self.centres):
            return probes.select("query").withColumn("id", F.lit(None).cast(self.lists.schema["id"].dataType)).withColumn("similarity", F.lit(0.0)).where("false")  # no rows, the right types
        probes = saved(probes, "probes")
        asked = np.zeros(len(self.shelved))
        for r in probes.groupBy("shelf").count().collect():
            asked[r["shelf"]] = r["count"]
        parts, blocks = (np.maximum(1, np.ceil(n / self.block)).astype(int) for n in (asked, self.shelved))
        spread = lambda counts: F.explode(F.sequence(F.lit(0), F.get(F.lit((counts - 1).tolist()), F.col("shelf"))))
        keys, n = ["shelf", "block", "part"], int(min(TASKS, max(1, (parts * blocks)[asked > 0].sum())))
        q = probes.withColumn("part", _block("query", "shelf", asked, self.block)).withColumn("block", spread(blocks)).repartition(n, *keys)
        x = self.lists.where(F.get(F.lit([bool(n) for n in asked]), F.col("shelf"))).withColumn("part", spread(parts)).repartition(n, *keys)
        centres, box, schema = self.centres, self.box, f"query {probes.schema['query'].dataType.simpleString()}, id {self.lists.schema['id'].dataType.simpleString()}, similarity double"

        def match(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(q) and len(x):
                a, floor, asks = _rows(q["vector"]), q["floor"].to_numpy(), q["query"].to_numpy()
                low, slack = floor.copy(), np.zeros(len(q))
                for one, rows in x.groupby("list"):
                    b, ids = _rows(rows["vector"]), rows["id"].to_numpy()
                    norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
                    kind = np.float32 if norms.max() < 1e30 else np.float64
                    slack = np.maximum(slack, (a.shape[1] + 4) * 1.2e-7 * norms + 10.0**-digits + _EPS)  # no less than the product's error and what rounding adds
                    along, across = split(a, centres[one][None])
                    reach = np.maximum(along * box[one, 0], along * box[one, 1])[:, 0] + across[:, 0] * box[one, 2]
                    for i in range(0, len(b), TILE):
                        take = np.flatnonzero(reach >= low - slack)
                        for at in (take[j : j + TILE] for j in range(0, len(take), TILE)):
                            found += _hits(a, b[i : i + TILE], at, asks, ids[i : i + TILE], floor, low, slack, kind, k, digits, same)
            if not found:
                return pd.DataFrame({"query": q["query"][:0], "id": x["id"][:0], "similarity": np.zeros(0)})
            row, out = np.concatenate([f[0] for f in found]), pd.DataFrame({"id": np.concatenate([f[1] for f in found]), "similarity": np.concatenate([f[2] for f in found])})
            out.insert(0, "query", asks[row])
            if k:
                out = out.assign(row=row).sort_values(["row", "similarity", "id"], ascending=[True, False, True], kind="stable")
                out = out[out.groupby("row").cumcount() < k].drop(columns="row")
            return out

        return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(match, schema)

    def _ready(self, queries: DataFrame, floor: float) -> DataFrame:
        q = queries.select("query", F.col("vector").cast("array<double>").alias("vector")).where((F.size("vector") == int(self.centres.shape[1] if len(self.centres) else -2)) & ~F.exists("vector", lambda v: v.isNull()))
        if not self.unit:
            norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
            q = q.withColumn("_n", norm).where("_n > 0").select("query", F.transform("vector", lambda v: v / F.col("_n")).alias("vector"))
        return q.withColumn("floor", F.lit(float(floor)))

    def search(self, queries: DataFrame, k: int = 10, least: float = -1e300, digits: int = 6, same: str = "skip") -> DataFrame:
        """(query, id, similarity): the k most similar rows of each query (query, vector), ties to the least id."""
        asked, order = self._ready(queries, least), [F.desc("similarity"), "id"]
        if len(self.shelved) <= 1:
            return top(self._compare(self._probes(asked), k, digits, same), ["query"], order, k)
        asked = saved(asked, "queries")
        near = saved(top(self._compare(self._probes(asked, True), k, digits, same), ["query"], order, k), "near")
        kth = near.groupBy("query").agg(F.min("similarity").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        rest = asked.join(kth, "query", "left").select("query", "vector", F.coalesce("s", "floor").alias("floor"))
        return top(near.union(self._compare(self._probes(rest, False), k, digits, same)), ["query"], order, k)

    def within(self, queries: DataFrame, least: float, digits: int = 6, same: str = "below") -> DataFrame:
        """(query, id, similarity): all rows of at least that similarity; by default each pair once, from its larger id."""
        return self._compare(self._probes(self._ready(queries, least)), None, digits, same)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0)


def _hits(a: np.ndarray, b: np.ndarray, at: np.ndarray, asks: np.ndarray, ids: np.ndarray, floor: np.ndarray, low: np.ndarray, slack: np.ndarray, kind: type, k: int | None, digits: int, same: str) -> list:
    """(row, id, similarity) of queries a[at] and items b at or over their floors. low: what a query's k-th best is at
    least so far; it is raised here if many pass."""
    s = a[at].astype(kind) @ b.astype(kind).T
    hit = s >= (low[at] - slack[at]).astype(kind)[:, None]
    if k and s.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(at):
        if same != "keep":
            s = np.where((ids[None] < asks[at][:, None]) if same == "below" else (ids[None] != asks[at][:, None]), s, -np.inf)
        s = np.where(s == s, s, -np.inf)
        low[at] = np.maximum(low[at], np.partition(s, -k, axis=1)[:, -k] - slack[at])
        hit = s >= (low[at] - slack[at]).astype(kind)[:, None]
    flat, out = np.flatnonzero(hit), []
    for i in range(0, len(flat), TILE * 16):
        row, col = np.divmod(flat[i : i + TILE * 16], len(b))
        row = at[row]
        sim = rounded(np.einsum("ij,ij->i", a[row], b[col]), digits)
        ok = sim >= floor[row]
        if same != "keep":
            ok &= (ids[col] < asks[row]) if same == "below" else (ids[col] != asks[row])
        out.append((row[ok], ids[col[ok]], sim[ok]))
    return out


def _block(key: str, place: str, counts: np.ndarray, block: int) -> Column:
    """A block of so many rows, about, inside a row's place, which has so many rows."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.get(F.lit([max(1, -(-int(n) // block)) for n in counts]), F.col(place))).cast("int")


def _window_cells(counts: dict[int, int], block: int) -> list[tuple[int, int, int, int]]:
    """(cell, window, block, side) of windows of so many rows: a block meets those of its window, each once, and all of the
    next window. Side 0 stands left; a block that meets itself stands left only."""
    blocks, out, cell = {w: -(-n // block) for w, n in counts.items()}, [], 0
    for w in sorted(blocks):
        for i in range(blocks[w]):
            for v, j in [(w, j) for j in range(i, blocks[w])] + [(w + 1, j) for j in range(blocks.get(w + 1, 0))]:
                out += [(cell, w, i, 0)] + [(cell, v, j, 1)] * ((v, j) != (w, i))
                cell += 1
    return out


def _near(left: pd.DataFrame, right: pd.DataFrame, least: float, reach: int, digits: int) -> Iterator[pd.DataFrame]:
    """Rows of one window and of the same (right is left, or another block) or the next one: (older, newer, similarity)."""
    same, following = right is left, left["w"].iloc[0] != right["w"].iloc[0]
    a, b = _rows(left["vector"]), _rows(right["vector"])
    asks, ids, floor = np.arange(len(a)), np.arange(len(b)), np.full(len(a), float(least))
    norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
    kind = np.float32 if norms.max() < 1e30 else np.float64
    slack = (a.shape[1] + 4) * 1.2e-7 * norms + 10.0**-digits + _EPS
    old = ["last_ts", "last_id"] if following else ["first_ts", "first_id"]
    (ta, ia), (tb, ib) = (left[c].to_numpy() for c in old), (right[c].to_numpy() for c in ("first_ts", "first_id"))
    ka, kb = left["key"].to_numpy(), right["key"].to_numpy()
    for i in range(0, len(b), TILE):
        for at in (asks[j : j + TILE] for j in range(0, len(a), TILE)):
            for row, col, s in _hits(a, b[i : i + TILE], at, asks, ids[i : i + TILE], floor, floor, slack, kind, None, digits, "below" if same else "keep"):
                ok = (s > least) & (ka[row] != kb[col]) & (np.abs(tb[col] - ta[row]) <= reach)
                row, col = row[ok], col[ok]
                up = (ta[row] < tb[col]) | ((ta[row] == tb[col]) & (ia[row] < ib[col]))
                yield pd.DataFrame({"older": np.where(up, ia[row], ib[col]), "newer": np.where(up, ib[col], ia[row]), "similarity": s[ok]})


def near_copies(atoms: DataFrame, least: float = 0.92, days: int = 30, digits: int = 5) -> DataFrame:
    """(older, newer, similarity): atoms (id, vector, ts) of more than `least` similarity within some days.

    Atoms of equal vectors are a class. Copies are not expanded into all pairs: in each window of `days`, members of a
    class hang on its first one, similar classes are linked by their first ones, and neighbouring windows from last
    to first. So everything within reach stays linked, rows are linear in atoms and class pairs, and each row is
    itself a pair within `days`. Classes of one length are compared only in windows that both have and in neighbouring ones:
    blocks of a window's classes meet in tasks, so a vector moves a few times, once a block, and no similar pair
    is kept that has no window."""
    span = days * 86_400_000_000
    key = F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary"))
    window = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(span))
    seen = saved(atoms.where("vector is not null and ts is not null").select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), key.alias("key"), window.alias("w"), "vector"), "atoms")
    ends = saved(seen.groupBy("key", "w").agg(F.min(F.struct("ts", "id")).alias("first"), F.max(F.struct("ts", "id")).alias("last"), F.first("vector").alias("vector")), "windows")
    star = seen.drop("vector").join(ends.select("key", "w", "first"), ["key", "w"]).where(F.col("id") != F.col("first.id")).select(F.col("first.id").alias("older"), F.col("id").alias("newer"), F.lit(1.0).alias("similarity"))
    own = ends.select("key", (F.col("w") + 1).alias("w"), "last").join(ends.select("key", "w", "first"), ["key", "w"]).where(F.col("first.ts") - F.col("last.ts") <= span).select(F.col("last.id").alias("older"), F.col("first.id").alias("newer"), F.lit(1.0).alias("similarity"))
    fit = ends.where((F.size("vector") > 0) & ~F.exists("vector", lambda v: v.isNull()))
    counts = {r.w: r.n for r in fit.groupBy("w").agg(F.count("*").alias("n")).collect()}
    cells = _window_cells(counts, BLOCK)
    id_type, spark = atoms.schema["id"].dataType.simpleString(), atoms.sparkSession
    if not cells:
        return star.union(own)
    blocks = spark.createDataFrame([(w, -(-n // BLOCK)) for w, n in counts.items()], "w long, blocks int")
    plan = spark.createDataFrame([(w, i, cell, side) for cell, w, i, side in cells], "w long, block int, cell int, side int")
    flat = ["w", "key", "vector", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("first", "last") for x in ("ts", "id")]]
    rows = fit.select(*flat).join(F.broadcast(blocks), "w").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).join(F.broadcast(plan), ["w", "block"])
    n = cells[-1][0] + 1
    tasks = min(TASKS, n)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        f = pd.concat(held)
        for _, cell in f.groupby(["cell", f["vector"].map(len)]):
            left, right = cell[cell["side"] == 0], cell[cell["side"] == 1]
            if len(left) and (len(right) or not crossed[cell["cell"].iloc[0]]):
                yield from _near(left, right if len(right) else left, least, span, digits)

    crossed = np.zeros(n, bool)
    crossed[[c[0] for c in cells if c[3] == 1]] = True
    met = rows.drop("blocks", "block").repartitionById(tasks, F.expr(f"cast(cast(cell as long) * {tasks} div {n} as int)")).mapInPandas(meet, f"older {id_type}, newer {id_type}, similarity double")
    return star.union(own).union(met)
