"""Joins over the graph: activity, neighbourhoods, timelines, spreading activation, bounded walks.

Edges are one view (src, dst[, kind, weight]). Walks have a fixed number of hops and aggregate after
each, so a hub costs its degree once a hop; small sides broadcast by Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.text import saturation
from mnemo.operators import grid
from mnemo.operators.frames import between, clamp, dealt, saved, top, within_budget


def recent_activity(activities: DataFrame, persons: DataFrame, containers: DataFrame, start, end, topics: DataFrame | None = None, limit: int | None = None, budget: int | None = None, by: list | None = None) -> DataFrame:
    """Activities with person and container in a window, newest first; optionally of topics (lower-cased),
    cut to a number of rows and a budget of snippet characters for each `by` group."""
    out = between(activities, "ts", start, end)
    if topics is not None:
        out = out.join(topics.select(F.lower("topic").alias("_t")).distinct(), F.lower(F.col("topic")) == F.col("_t"), "left_semi")
    out = out.join(persons, "person").join(containers, "container")
    if limit is not None:
        by, order = by or ["container"], [F.desc("ts"), "source_id"]
        out = within_budget(out, by, order, "snippet", budget, limit) if budget is not None else top(out, by, order, limit)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected (a, b, weight) as directed (src, dst, weight), reading the edges once."""
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    return edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), "weight").select("e.src", "e.dst", "weight")


def neighborhood(edges: DataFrame, roots: DataFrame, direction: str = "in", kinds: list | None = None, most: int = 40) -> DataFrame:
    """One hop around each root (column root): root, kind, neighbour; at most `most` edges a root."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    into = e.select(F.col("dst").alias("root"), "kind", F.col("src").alias("neighbour"))
    out = e.select(F.col("src").alias("root"), "kind", F.col("dst").alias("neighbour"))
    found = {"in": into, "out": out, "both": into.union(out)}[direction].join(roots.select("root").distinct(), "root", "left_semi").distinct()
    return top(found, ["root"], ["kind", "neighbour"], most)


def overview(edges: DataFrame, roots: DataFrame, most: int = 500) -> DataFrame:
    """The neighbourhoods of up to `most` roots of each label, edges once."""
    return neighborhood(edges, top(roots, ["label"], ["root"], most).select("root"), "both").select(F.least("root", "neighbour").alias("source"), "kind", F.greatest("root", "neighbour").alias("target")).distinct()


#: Neighbours of a block of an adjacency list; nodes of a frontier that the first test of a pair looks at, and the factor to the next.
BLOCK, LOOK, GROWTH = 1000, 2, 4
#: Pairs that are told by looks; more go to a grid.
LOOK_PAIRS = 2_000_000


class Adjacency:
    """Distinct steps src -> dst, saved once by src, a hub's dealt over blocks of BLOCK so that no task meets a whole hub.

    steps: (src, block, dst); degrees: (src, degree, blocks)."""

    def __init__(self, edges: DataFrame):
        step = saved(edges.select("src", "dst").repartition("src").distinct().sortWithinPartitions("src", "dst"), "steps")
        self.degrees = saved(step.groupBy("src").agg(F.count("*").alias("degree")).withColumn("blocks", F.ceil(F.col("degree") / BLOCK).cast("int")), "degrees")
        block = F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int")
        self.lists = None  # (src, block, dsts), made when first asked for
        self.steps = step.join(self.degrees.where("blocks > 1").select("src", "blocks"), "src", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("src", block.alias("block"), "dst")

    def first(self, roots: DataFrame) -> DataFrame:
        """(root, node) one step on from each of distinct roots: the steps as they stand, which are distinct."""
        return self.steps.select(F.col("src").alias("root"), F.col("dst").alias("node")).join(roots, "root", "left_semi").where("root <> node")

    def lone(self, roots: DataFrame) -> DataFrame:
        """(root, node): steps into distinct roots from nodes that they have no step to. Both ways of a pair meet in one group."""
        pair = self.steps.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), (F.col("src") < F.col("dst")).alias("up"))
        one = pair.where("low <> high").groupBy("low", "high").agg(F.min("up").alias("up"), F.count("*").alias("n")).where("n = 1")
        return one.select(F.when(F.col("up"), F.col("high")).otherwise(F.col("low")).alias("root"), F.when(F.col("up"), F.col("low")).otherwise(F.col("high")).alias("node")).join(roots, "root", "left_semi")

    def next(self, front: DataFrame) -> DataFrame:
        """(root, node) one step on from front (root, node), distinct."""
        at = front.select("root", F.col("node").alias("src")).join(self.degrees.select("src", "blocks"), "src")
        at = at.select("root", "src", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return at.join(self.steps, ["src", "block"]).select("root", F.col("dst").alias("node")).distinct()

    def unmet(self, front: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs (root, node) of which no front node of the root has a step to the node.

        Pairs are tried with a few of the front's nodes first and the rest go on to more, so that pairs which
        many nodes would tell cost a few looks, not the product of degrees. A root's nodes lie in lists of
        about BLOCK and meet the lists of steps whole, so that a look moves lists, not a row a pair.

        Where few nodes tell of a pair, looks move the lists of all pairs to most of the front. Very many pairs are therefore
        told in a grid, to which a step moves a bounded number of times."""
        if pairs.count() > LOOK_PAIRS:
            by_node, on = front.select(F.col("node").alias("set"), F.col("root").alias("left")), self.steps.select(F.col("src").alias("set"), F.col("dst").alias("right"))
            return grid.unmet(by_node, on, pairs.select(F.col("root").alias("left"), F.col("node").alias("right")), front.count() + on.count()).toDF("root", "node")
        if self.lists is None:
            self.lists = saved(self.steps.groupBy("src", "block").agg(F.collect_list("dst").alias("dsts")), "lists")
        size = saved(front.groupBy("root").agg(F.count("*").alias("n")), "sizes")
        place = F.pmod(F.xxhash64("node", "root"), F.lit(1 << 30)) * F.col("n") / F.lit(float(1 << 30))
        turn = F.greatest(F.lit(0), F.ceil(F.log(place / LOOK) / F.log(F.lit(float(GROWTH)))))
        look = front.join(size, "root").select("root", F.col("node").alias("src"), F.coalesce(turn, F.lit(0)).cast("int").alias("turn"))
        count = saved(pairs.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "counts")
        part = F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
        asks = saved(pairs.join(count, "root").select("root", part, "node").groupBy("root", "part").agg(F.collect_list("node").alias("nodes")), "asks")
        whole = lambda block, nodes: F.struct(block.cast("int").alias("block"), nodes.alias("nodes"))
        for i in range(1 + (look.agg(F.max("turn")).head()[0] or 0)):
            at = look.where(F.col("turn") == i).select("root", "src").join(self.degrees.select("src", "blocks"), "src")
            apart = F.transform("nodes", lambda n: whole(F.pmod(F.xxhash64(n), F.col("blocks")), F.array(n)))  # to a hub's blocks
            tried = asks.join(at, "root").select("root", "part", "src", F.explode(F.when(F.col("blocks") == 1, F.array(whole(F.lit(0), F.col("nodes")))).otherwise(apart)).alias("t")).select("root", "part", "src", "t.*")
            told = tried.join(self.lists, ["src", "block"]).select("root", "part", F.array_intersect("nodes", "dsts").alias("told")).where(F.size("told") > 0)
            told = told.groupBy("root", "part").agg(F.array_distinct(F.flatten(F.collect_list("told"))).alias("told"))
            left = F.when(F.col("told").isNull(), F.col("nodes")).otherwise(F.array_except("nodes", "told"))
            asks = saved(asks.join(told, ["root", "part"], "left").select("root", "part", left.alias("nodes")).where(F.size("nodes") > 0), "unmet")
        return asks.select("root", F.explode("nodes").alias("node"))


def full(seen: DataFrame, enough: int) -> DataFrame:
    """(root) of roots with so many nodes below them; saved, so that a join knows how few they are."""
    return saved(seen.where("depth > 0").groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("root"), "full")


def walk(adjacency: Adjacency, roots: DataFrame, hops: int, enough: int | None = None) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(depth, front, seen) by levels: front (root, node) is what a root first reaches at that depth, seen (root,
    node, depth) all so far, the root itself at 0. A node is expanded once a root. With `enough`, a root
    that has so many nodes below it is not expanded further."""
    front = saved(roots.select("root", F.col("root").alias("node")).distinct(), "front")
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        old = seen
        if enough is not None and depth > 1:
            done = full(seen, enough)
            front, old = front.join(done, "root", "left_anti"), seen.join(done, "root", "left_anti")
        if depth == 1:
            on = adjacency.first(front.select("root"))
        elif front.isEmpty():  # no steps are moved
            on = front.limit(0)
        else:
            on = adjacency.next(front).join(old.select("root", "node"), ["root", "node"], "left_anti")
        front = saved(on, "front")
        seen = seen.union(front.withColumn("depth", F.lit(depth)))
        yield depth, front, seen


def reach(edges: DataFrame, roots: DataFrame, hops: int, enough: int | None = None) -> DataFrame:
    """(root, node, depth): nodes within 1..hops steps along src -> dst, each at its least depth. Nulls are no
    nodes. With `enough`, levels after a root's first so many nodes are left out, its full levels are whole."""
    seen = None
    for _, _, seen in walk(Adjacency(edges.where("src is not null and dst is not null")), roots.where("root is not null"), hops, enough):
        pass
    return seen.where("depth > 0")


def timeline(edges: DataFrame, roots: DataFrame, activities: DataFrame, hops: int = 2, start=None, end=None) -> DataFrame:
    """Activities within `hops` (1..3) steps against edge direction of each root: (root, activity columns),
    distinct. Edges run from activities to what they touch; activities have column node."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, roots, clamp(hops, 1, 3)).select("root", "node").join(between(activities, "ts", start, end), "node")


def related(touches: DataFrame, seeds: DataFrame, n: int = 3, per_label: int = 3, own_label: bool = True) -> DataFrame:
    """Seeds (node, label) and what their activities also touch: (seed, activities, label, other, paths).

    touches: (activity, label, node). Paths are counted, not nodes, by joining pre-counted pairs;
    own_label False leaves out nodes of the seed's label.
    """
    t = touches.groupBy("activity", "label", "node").agg(F.count("*").alias("k"))
    own = t.join(seeds.select("node", "label").distinct(), ["node", "label"], "left_semi").select("activity", F.col("node").alias("seed"), F.col("label").alias("seed_label"), F.col("k").alias("k1"))
    count = own.groupBy("seed").agg(F.count_distinct("activity").alias("activities"))
    other = (F.col("seed_label") != F.col("label")) | ((F.col("seed") != F.col("node")) & F.lit(own_label))
    paths = own.join(t, "activity").where(other).groupBy("seed", "label", F.col("node").alias("other")).agg(F.sum(F.col("k1") * F.col("k")).alias("paths"))
    order = [F.desc("paths"), "label", "other"]
    return count.join(top(top(paths, ["seed", "label"], order, per_label), ["seed"], order, n), "seed", "left")


def summary(touches: DataFrame, activities: DataFrame, seeds: DataFrame, n: int = 10, per_label: int = 5) -> DataFrame:
    """related() nodes of other labels, with the latest time of the seed's activities."""
    last = touches.join(seeds.select("node", "label"), ["node", "label"], "left_semi").join(activities.select("activity", "ts"), "activity").groupBy(F.col("node").alias("seed")).agg(F.max("ts").alias("latest"))
    return related(touches, seeds, n, per_label, False).join(last, "seed", "left")


def mentioning_atoms(mentions: DataFrame, wanted: DataFrame, by: list | None = None, least: float | None = None) -> DataFrame:
    """Atoms that mention wanted entities: summed prominence (a missing one counts 0.5) and distinct matches;
    `least` leaves out mentions of less prominence."""
    by = by or []
    mentions = mentions if least is None else mentions.where(F.coalesce(F.col("prominence").cast("double"), F.lit(0.5)) >= least)
    p = F.coalesce(F.col("prominence").cast("double"), F.lit(0.5))
    return mentions.join(wanted.select(*by, "entity").distinct(), "entity").groupBy(*by, "atom").agg(F.sum(p).alias("score"), F.count_distinct("entity").alias("matches"))


def atoms_of_episodes(atoms: DataFrame, links: DataFrame, episodes: DataFrame) -> DataFrame:
    return links.join(episodes.select("episode"), "episode").join(atoms, "atom").select("episode", "atom", "created_at")


def episode_sizes(episodes: DataFrame, links: DataFrame) -> DataFrame:
    return episodes.join(links, "episode", "left").groupBy("episode").agg(F.count("atom").alias("atoms"))


def spread_activation(edges: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, hops: int = 2, decay: float = 0.5, top_k: int = 50, digits: int = 9) -> DataFrame:
    """(cue, entity, activation): an undirected spread that keeps the strongest way in.

    edges: a < b with weight, made and saved once for all hops; or a function that gives the ways (src, dst, weight)
    out of distinct nodes (entity), which each hop asks for the nodes that go on. A hop h adds score * w/(w+3) * decay**h from every node reached so far in
    the hop before; activation is the greatest of all contributions. Each hop is one join on the
    frontier and one map-side combined max; scores are rounded so that ties order alike everywhere.

    A way in never gains, so with decay up to 1 nothing below a cue's top_k-th best so far can enter its cut, nor
    lead to what does, and a node that a hop does not raise has told its neighbours before. Neither goes on. Edges
    are not made if nothing goes on.
    """
    score = saved(seeds.groupBy("cue", "entity").agg(F.max("activation").alias("activation")), "score")
    front, ways = score, None
    last = clamp(hops, 1, 2)
    for h in range(1, last + 1):
        if decay <= 1:
            kth = top(score, ["cue"], [F.desc("activation"), "entity"], top_k, "r").where(F.col("r") == top_k).where("activation > 0").select("cue", F.col("activation").alias("kth"))
            kth = saved(kth, "kth")
        else:
            kth = score.select("cue", F.lit(0.0).alias("kth")).limit(0)
        low = F.col("kth").isNull()
        front = saved(front.join(kth, "cue", "left").where(low | (F.col("activation") * decay**h >= F.col("kth") - 10.0**-digits)), "front")
        if front.isEmpty():
            break
        if not isinstance(edges, DataFrame):
            ways = edges(front.select("entity").distinct())
        elif ways is None:
            ways = both_ways(saved(edges.select("a", "b", "weight"), "edges"))
        gain = F.round(F.col("activation") * saturation(F.col("weight")) * decay**h, digits)
        gains = front.join(ways, front["entity"] == ways["src"]).select("cue", F.col("dst").alias("entity"), "kth", gain.alias("activation"))
        reached = saved(gains.where(low | (F.col("activation") >= F.col("kth"))).groupBy("cue", "entity").agg(F.max("activation").alias("activation")), "reached")
        was = score.withColumnRenamed("activation", "was")
        on = reached.join(was, ["cue", "entity"], "left").where(F.col("was").isNull() | (F.col("activation") > F.col("was")) | (F.col("was") < 0) | F.lit(decay > 1))
        front = on.select("cue", "entity", F.greatest("activation", "was").alias("activation"))
        score = score.union(reached).groupBy("cue", "entity").agg(F.max("activation").alias("activation"))
        score = saved(score, "score") if h < last else score
    return top(score, ["cue"], [F.desc("activation"), "entity"], top_k)


def induced(edges: DataFrame, nodes: DataFrame, key: str = "cue") -> DataFrame:
    """Edges a < b with both ends among the nodes of one key."""
    a, b = nodes.select(key, F.col("entity").alias("a")), nodes.select(key, F.col("entity").alias("b"))
    return edges.join(a, "a").join(b, [key, "b"]).select(key, "a", "b", "weight")


def context_overlap(candidates: DataFrame, edges: DataFrame, names: DataFrame, co_names: DataFrame) -> DataFrame:
    """(mention, entity, overlap): distinct neighbours named in the mention's co-entity list over max(3, list), at most 1."""
    n = co_names.groupBy("mention").agg(F.count_distinct("name").alias("n"))
    near = candidates.join(both_ways(edges), F.col("entity") == F.col("src")).join(names.select(F.col("entity").alias("dst"), F.lower("name").alias("name")), "dst")
    hit = near.join(co_names.select("mention", F.lower("name").alias("name")).distinct(), ["mention", "name"]).groupBy("mention", "entity").agg(F.count_distinct("dst").alias("k"))
    return candidates.select("mention", "entity").distinct().join(hit, ["mention", "entity"], "left").join(n, "mention", "left").select("mention", "entity", F.least(F.lit(1.0), F.coalesce("k", F.lit(0)) / F.greatest(F.lit(3), F.coalesce("n", F.lit(0)))).alias("overlap"))


def place_match(candidates: DataFrame, mentions: DataFrame, atoms: DataFrame) -> DataFrame:
    """(mention, entity, place): 1 where the entity was already mentioned from the mention's folder."""
    known = mentions.join(atoms.select("atom", "cwd"), "atom").select("entity", "cwd").distinct().withColumn("_hit", F.lit(1))
    return candidates.join(known, ["entity", "cwd"], "left").groupBy("mention", "entity").agg(F.max(F.coalesce("_hit", F.lit(0))).alias("place"))


def impact(edges: DataFrame, roots: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(root, node, kind, depth): what roots reach downstream within depth 1..4, and their direct dependents;
    a node found both ways is downstream. By depth, kind and node, at most `most` a root.

    A root with `most` nodes on its first levels is not walked further: nothing deeper can enter the cut.
    Only its dependents matter then, since one that is also reached later is downstream and not a
    dependent; they are told by looking for any step into them."""
    adjacency = Adjacency(edges.where("src is not null and dst is not null and src <> dst"))
    roots = saved(roots.select("root").where("root is not null").distinct(), "roots")
    pending, told, deep, seen = None, None, clamp(depth, 1, 4), None
    for d, front, seen in walk(adjacency, roots, deep, most):
        pending = saved(adjacency.lone(roots) if pending is None else pending.join(front, ["root", "node"], "left_anti"), "pending")
        if d < deep:
            done = full(seen, most)
            asked, pending = pending.join(done, "root", "left_semi"), pending.join(done, "root", "left_anti")
            at = front.join(done, "root", "left_semi")
            for later in range(d + 1, deep + 1):  # of roots that are not walked on
                asked = adjacency.unmet(at, asked)
                if later < deep:
                    at = saved(adjacency.next(at.join(asked.select("root").distinct(), "root", "left_semi")), "at")
            told = asked if told is None else told.union(asked)
    pending = pending if told is None else pending.union(told)
    down = seen.where("depth > 0").select("root", "node", "depth", F.lit("downstream").alias("kind"))
    found = down.unionByName(pending.select("root", "node", F.lit(1).alias("depth"), F.lit("dependent").alias("kind")))
    return top(found, ["root"], ["depth", "kind", "node"], most).select("root", "node", "kind", "depth")


def network(edges: DataFrame, roots: DataFrame, depth: int = 1, most: int = 50) -> DataFrame:
    """(root, node, depth) within depth 1..2 of undirected edges, the root first, at most `most` nodes. A root that
    has enough neighbours is not walked further."""
    near = reach(both_ways(edges), roots, clamp(depth, 1, 2), most - 1)
    return top(near.union(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()), ["root"], ["depth", "node"], most)


def network_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, a, b, weight): edges a < b with both ends among a root's network (root, node). A network is cut to a
    few nodes, so its pairs are few whatever the degrees: they are looked up, hubs are not expanded."""
    n = saved(nodes.select("root", "node"), "network")
    pairs = n.select("root", F.col("node").alias("a")).join(n.select("root", F.col("node").alias("b")), "root").where("a < b")
    return pairs.join(edges.select("a", "b", "weight"), ["a", "b"]).select("root", "a", "b", "weight")


def entity_detail(edges: DataFrame, mentions: DataFrame, atoms: DataFrame, wanted: DataFrame, n: int = 15, pairs: int | None = None, lines: int | None = None) -> DataFrame:
    """A tagged union a wanted entity: its strongest associations and its newest mentioning atoms. Both are dealt by
    entity as for so many pairs and mentions, if those are given, since a task's part of an entity is hardly cut."""
    strong = dealt(both_ways(edges).join(wanted.select(F.col("entity").alias("src")), "src", "left_semi"), 2 * (pairs or 0), "src")
    strong = top(strong, ["src"], [F.desc("weight"), "dst"], n, "rank").select(F.col("src").alias("entity"), F.lit("association").alias("what"), F.col("dst").cast("long").alias("other"), F.col("weight").cast("long").alias("value"), "rank")
    new = mentions.join(wanted.select("entity"), "entity", "left_semi").join(atoms.select("atom", "created_at"), "atom")
    new = top(dealt(new, lines, "entity"), ["entity"], [F.desc("created_at"), "atom"], n, "rank").select("entity", F.lit("atom").alias("what"), F.col("atom").cast("long").alias("other"), F.col("prominence").cast("long").alias("value"), "rank")
    return strong.union(new)


def atom_detail(mentions: DataFrame, atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted atoms with their mentions, most prominent first, as one text."""
    one = F.concat_ws(":", "entity", "prominence")
    m = mentions.join(wanted, "atom", "left_semi").groupBy("atom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("prominence")).alias("p"), "entity", one.alias("t")))), lambda x: x["t"]), ",").alias("mentions"))
    return atoms.join(wanted, "atom", "left_semi").join(m, "atom", "left")


def node_view(tables: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """One view (label, id, name) of labelled tables {label: (table, key columns, name column)}; keys of
    several columns are joined by colons."""
    out = None
    for label, (df, keys, name) in tables.items():
        one = df.select(F.lit(label).alias("label"), F.concat_ws(":", *keys).alias("id"), F.col(name).cast("string").alias("name"))
        out = one if out is None else out.union(one)
    return out


def resolve_ids(ids: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """(id, label, name): each id's node in the first label of `order` that has it."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("label"))
    hit = ids.select("id").distinct().join(nodes.where(F.col("label").isin(order)), "id")
    return hit.groupBy("id").agg(F.min_by(F.struct("label", "name"), F.struct(rank, "name")).alias("x")).select("id", "x.*")
