"""Ranked text search on an inverted index, name lookups, cue seeds, and vector search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.text import terms
from mnemo.operators.frames import latest, saved, scratch, top
from mnemo.operators.store import Store, _ddl
from mnemo.operators.vectors import BLOCK, TILE, VectorIndex

K1, B = 1.2, 0.75


#: Buckets of terms, and documents of a block, on the average.
BUCKETS, BLOCK_DOCS = 32, 128
#: Blocks that a query scores first, to learn what its k-th best is at least, and blocks that are scored whole.
FIRST, FEW = 4, 256
#: A term that more queries ask for is scored once a set of such terms, if a set has so many queries on the average.
COMMON, SHARING = 1_000, 8
#: Vectors that ask at most, for which no lists are fitted: to deal all items into lists costs more than to compare them.
FEW_QUERIES = 1_000
#: Documents that a task of search_once holds, on the average, and (query, document) cells that it sums at once.
CHUNK_DOCS, CELLS = 2_048, 1 << 17


class Index:
    """A saved text index in segments: an update adds one of new and changed documents and rewrites nothing.

    postings: (label, segment, block, term, id, tf, n) and, for segments of more than FEW blocks, heads: (label,
    segment, block, term, docs, most_tf, least_n), a row a term and block of documents, both in folders by
    bucket of terms; documents: (label, id, segment, hash); sizes: (label, docs, total) of each segment, with what it replaces counted back. most_tf and
    least_n bound any score in the block whatever the collection's averages become. A search reads the
    buckets of its terms: first heads, then the postings of blocks that may still reach a query's k-th best."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)
        self.spark, self.pinned = spark, self.store.manifest()

    @staticmethod
    def build(texts: DataFrame, path: str | None = None) -> Index:
        """texts: (label, id, text), several rows a document allowed (one a column). Null texts are empty. The
        first build decides the type of ids. Without a path the index is a scratch table."""
        index = Index(texts.sparkSession, path or scratch(texts.sparkSession, "index"))
        index.update(texts)
        return index

    def update(self, texts: DataFrame) -> int | None:
        """Adds documents that are new or whose text changed; others are neither tokenised nor written. Returns
        the number of the segment, None if nothing changed."""
        manifest = self.store.manifest()
        new = _whole(texts).withColumn("hash", F.xxhash64("text"))
        segment, old = 1 + len(manifest["tables"].get("sizes", {"parts": {}})["parts"].get("0", [])), None
        if "documents" in manifest["tables"]:
            old = self._live(manifest)
            new = new.join(old.select("label", "id", "hash"), ["label", "id", "hash"], "left_anti")
        n = new.count()
        if not n and manifest["tables"]:
            return None
        blocks = max(1, -(-n // BLOCK_DOCS))
        block = F.pmod(F.xxhash64("label", F.col("id").cast("string")), F.lit(blocks)).cast("int")
        tok = new.select("label", block.alias("block"), "id", "text").repartition("block")  # all that follows is grouped inside blocks
        tok = tok.select("label", "block", "id", terms(F.col("text")).alias("t")).select("label", "block", "id", F.size("t").cast("long").alias("n"), F.explode("t").alias("term"))
        tf = tok.groupBy("label", "block", "id", "n", "term").agg(F.count("*").alias("tf"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("_bucket")
        post = tf.select("label", F.lit(segment).alias("segment"), "block", "term", "id", "tf", "n", bucket).repartition("_bucket").sortWithinPartitions("_bucket", "label", "term", "block")
        post_parts = self.store.stage(post, bucketed=True)
        written = self.store.open(post.drop("_bucket"), post_parts)
        staged = {"postings": (post.drop("_bucket"), post_parts)}
        if blocks > FEW:
            heads = _heads(written)
            staged["heads"] = (heads, self.store.stage(heads.select("*", bucket).repartition("_bucket").sortWithinPartitions("_bucket", "label", "term"), bucketed=True))
        docs = new.select("label", "id", F.lit(segment).alias("segment"), "hash")
        staged["documents"] = (docs, self.store.stage(docs))
        known = self.store.open(docs, staged["documents"][1])
        total = written.groupBy("label").agg(F.sum("tf").alias("total"))
        sizes = known.groupBy("label").agg(F.count("*").alias("docs")).join(total, "label", "left").fillna(0, ["total"])
        replaced = False
        if old is not None:
            gone = old.join(known.select("label", "id"), ["label", "id"], "left_semi").select("label", "id", "segment")
            replaced = bool(gone.limit(1).count())
            if replaced:
                lost = self.store.read("postings", manifest).join(gone, ["label", "id", "segment"], "left_semi").groupBy("label").agg((-F.sum("tf")).alias("total"))
                sizes = sizes.union(gone.groupBy("label").agg((-F.count("*")).alias("docs")).join(lost, "label", "left").fillna(0, ["total"]))
        staged["sizes"] = (sizes, self.store.stage(sizes))
        for name, (df, parts) in staged.items():
            table = manifest["tables"].setdefault(name, {"schema": _ddl(df), "parts": {}})
            for b, folders in parts.items():
                table["parts"][b] = table["parts"].get(b, []) + folders
        manifest.setdefault("blocks", []).append(blocks)
        manifest["replaced"] = manifest.get("replaced", False) or replaced
        self.store.publish(manifest)
        self.pinned = self.store.manifest()
        return segment

    def _live(self, manifest: dict) -> DataFrame:
        """The newest row of each document."""
        docs = self.store.read("documents", manifest)
        return latest(docs, ["label", "id"], ["segment"]) if len(manifest["blocks"]) > 1 else docs

    def search(self, queries: DataFrame, k: int = 10, least: float = 0.0, overall: int | None = None, digits: int = 6) -> DataFrame:
        """queries (query, text) to (query, label, id, score): BM25 with the top k of each label over `least`,
        then the top `overall` of each query. Equal scores are ordered by id."""
        m = self.pinned
        if "postings" not in m["tables"]:
            raise ValueError("the index is empty: build it first")
        q = queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        wanted = q.select("term").distinct()
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        post = self.store.read("postings", m, buckets)
        sizes = self.store.read("sizes", m).groupBy("label").agg(F.sum("docs").alias("all_docs"), F.sum("total").alias("total"))
        dead = self._dead(m) if m["replaced"] else None
        few = sum(m["blocks"]) <= FEW  # nothing to gain by bounds
        heads = None if few else self._all_heads(m, buckets, post).join(wanted, "term", "left_semi")
        df = post.join(wanted, "term", "left_semi").groupBy("label", "term").agg(F.count("*").alias("df")) if few else heads.groupBy("label", "term").agg(F.sum("docs").alias("df"))
        if dead is not None:  # replaced documents still stand in old blocks
            lost = post.join(wanted, "term", "left_semi").join(dead, ["label", "id", "segment"], "left_semi").groupBy("label", "term").agg((-F.count("*")).alias("df"))
            df = df.union(lost).groupBy("label", "term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.col("all_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = df.where("df > 0").join(sizes, "label").select("label", "term", idf.alias("idf"), "all_docs", "total")
        weight = weight if few else saved(weight, "weights")
        gain = lambda tf, n: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n * F.col("all_docs") / F.col("total")))
        part = F.floor(gain(F.col("tf"), F.col("n")) * 1e9 + 0.5)  # whole billionths: sums do not depend on order
        order, place = [F.desc("score"), "id"], ["label", "segment", "block"]

        def scored(pairs: DataFrame | None) -> DataFrame:
            """Scores of all documents, or of those in (query, label, segment, block); each hit is weighed once."""
            hits = post.join(wanted, "term", "left_semi") if pairs is None else post.join(pairs.select(*place).distinct(), place, "left_semi")
            hits = hits if dead is None else hits.join(dead, ["label", "id", "segment"], "left_anti")
            parts = hits.join(weight, ["label", "term"]).select(*place, "term", "id", part.alias("part"))
            asked = q.join(parts, "term") if pairs is None else pairs.join(q, "query").join(parts, [*place, "term"])
            found = asked.groupBy("query", "label", "id").agg((F.floor(F.sum("part") / 1e9 * 10.0**digits + 0.5) / 10.0**digits).alias("score"))
            return top(found.where(F.col("score") > least), ["query", "label"], order, k)

        shared = _shared(q)
        if shared is not None:
            hits = post.join(wanted, "term", "left_semi")
            hits = hits if dead is None else hits.join(dead, ["label", "id", "segment"], "left_anti")
            ranked = _by_sets(q, *shared, hits.join(weight, ["label", "term"]).select("label", "id", "term", part.alias("part")), k, least, digits)
        elif few:
            ranked = scored(None)
        else:
            best = heads.join(weight, ["label", "term"]).select(*place, "term", (gain(F.col("most_tf"), F.col("least_n")) + 2e-9).alias("best"))
            bound = saved(q.join(best, "term").groupBy("query", *place).agg(F.sum("best").alias("best")), "bounds")
            first = saved(top(bound, ["query", "label"], [F.desc("best"), "segment", "block"], FIRST), "first")
            early = saved(scored(first.select("query", *place)), "early")
            kth = early.groupBy("query", "label").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
            rest = bound.join(first.select("query", *place), ["query", *place], "left_anti").join(kth, ["query", "label"], "left")
            rest = rest.where(F.coalesce("kth", F.lit(float(least))) <= F.col("best") + 10.0**-digits).select("query", *place)
            ranked = top(early.union(scored(saved(rest, "rest"))), ["query", "label"], order, k)
        return ranked if overall is None else top(ranked, ["query"], [F.desc("score"), "label", "id"], overall)

    def _all_heads(self, m: dict, buckets: list, post: DataFrame) -> DataFrame:
        """Heads of all segments; those of small segments, which have none saved, are made from their postings."""
        small = [i + 1 for i, n in enumerate(m["blocks"]) if n <= FEW]
        made = _heads(post.where(F.col("segment").isin(small)))
        return self.store.read("heads", m, buckets).unionByName(made) if "heads" in m["tables"] else made

    def _dead(self, m: dict) -> DataFrame:
        docs = self.store.read("documents", m)
        last = docs.groupBy("label", "id").agg(F.max("segment").alias("last"), F.count("*").alias("c")).where("c > 1").drop("c")
        return docs.join(last, ["label", "id"]).where("segment < last").select("label", "id", "segment")


def _shared(q: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Terms that more than COMMON queries ask for and each query's set of them (query, terms), if a set has SHARING
    queries or more on the average."""
    common = q.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("term")
    if not common.limit(1).count():
        return None
    common = saved(common, "common")
    sets = saved(q.join(common, "term").groupBy("query").agg(F.array_sort(F.collect_list("term")).alias("terms")), "sets")
    n = sets.agg(F.count("*").alias("queries"), F.count_distinct("terms").alias("sets")).head()
    return (common, sets) if n.sets * SHARING <= n.queries else None


def _by_sets(q: DataFrame, common: DataFrame, sets: DataFrame, parts: DataFrame, k: int, least: float, digits: int) -> DataFrame:
    """(query, label, id, score) of q (query, term) on parts (label, id, term, part), k best a query and label.

    A set of common terms is scored once for all queries that share it. A query's best are among the k best of
    its set and the documents that its other terms find: what is not found by those scores no more than k of
    the set that come before it."""
    score = lambda c: (F.floor(c / 1e9 * 10.0**digits + 0.5) / 10.0**digits).alias("score")
    order, doc = [F.desc("score"), "id"], ["label", "id"]
    each = sets.select("terms").distinct().select("terms", F.explode("terms").alias("term"))
    base = saved(each.join(parts, "term").groupBy("terms", *doc).agg(F.sum("part").alias("base")), "bases")
    best = top(base.select("terms", *doc, score(F.col("base"))).where(F.col("score") > least), ["terms", "label"], order, k)
    own = q.join(common, "term", "left_anti").join(parts, "term").groupBy("query", *doc).agg(F.sum("part").alias("part"))
    own = own.join(sets, "query", "left").join(base, ["terms", *doc], "left")
    found = sets.join(best, "terms").select("query", *doc, "score").union(own.select("query", *doc, score(F.col("part") + F.coalesce("base", F.lit(0)))))
    found = found.groupBy("query", *doc).agg(F.max("score").alias("score"))
    return top(found.where(F.col("score") > least), ["query", "label"], order, k)


def _heads(post: DataFrame) -> DataFrame:
    return post.groupBy("label", "segment", "block", "term").agg(F.count("*").alias("docs"), F.max("tf").alias("most_tf"), F.min("n").alias("least_n"))


def _repeated(texts: DataFrame) -> bool:
    return bool(texts.groupBy("label", "id").count().where("count > 1").limit(1).count())


def _whole(texts: DataFrame) -> DataFrame:
    """One text a document; null texts are empty."""
    whole = texts.select("label", "id", F.coalesce("text", F.lit("")).alias("text"))
    if _repeated(whole):
        whole = whole.groupBy("label", "id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return whole


def search_once(texts: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, digits: int = 6, equal: bool = False) -> DataFrame:
    """(query, label, id, score): what Index.build(texts).search(queries, k, least) gives, for texts that are searched
    only this once. Nothing is indexed: every text is tokenised, and only postings of asked terms are kept.

    Documents are dealt over chunks; a chunk's postings meet all queries and give the k best of each query. Queries are
    copied to every chunk, so for very many of them an Index is better.

    equal: many texts are equal, so that each is searched once, under its least id, and counted as often as it stands.
    Equal texts score alike, so a query's k best are among the k least ids of its k best texts."""
    asked = queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    q = saved(asked, "asked")
    wanted = saved(q.select("term").union(q.sparkSession.range(1).select(F.lit("").alias("term"))).distinct(), "wanted")  # no term is empty: a row a document, for sizes
    whole, firsts = _whole(texts), None
    if equal:
        firsts = saved(top(whole, ["label", "text"], ["id"], k, "r"), "firsts")
        copies = whole.groupBy("label", "text").agg(F.count("*").alias("copies"))
        whole = saved(firsts.where("r = 1").join(copies, ["label", "text"]).select("label", "id", "text", "copies"), "texts")
    else:
        whole = whole.withColumn("copies", F.lit(1).cast("long"))
    docs = whole.count()
    chunks = max(1, -(-docs // CHUNK_DOCS), min(-(-docs // BLOCK_DOCS), q.sparkSession.sparkContext.defaultParallelism))
    chunk = F.pmod(F.xxhash64("label", F.col("id").cast("string")), F.lit(chunks)).cast("int").alias("chunk")
    tok = whole.select("label", chunk, "id", "copies", "text").repartition(chunks, "chunk").select("label", "chunk", "id", "copies", terms(F.col("text")).alias("t"))
    tok = tok.select("label", "chunk", "id", "copies", F.size("t").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    post = saved(tok.join(wanted, "term", "left_semi").groupBy("label", "chunk", "id", "copies", "n", "term").agg(F.count("*").alias("tf")), "postings")
    sizes = post.where("term = ''").groupBy("label").agg(F.sum("copies").alias("all_docs"), F.sum(F.col("n") * F.col("copies")).alias("total"))
    post = post.where("term <> ''")
    idf = F.log(1 + (F.col("all_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = saved(post.groupBy("label", "term").agg(F.sum("copies").alias("df")).join(sizes, "label").select("label", "term", idf.alias("idf"), "all_docs", "total"), "weights")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") * F.col("all_docs") / F.col("total")))
    parts = post.join(weight, ["label", "term"]).select("label", "chunk", "id", "term", F.floor(gain * 1e9 + 0.5).alias("part")).repartition(chunks, "label", "chunk")
    places = weight.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    told = q.crossJoin(places).repartition(chunks, "label", "chunk")
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema, *parts.schema]}

    def best(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = [_best_of(p, q, k, least, digits)] if len(p) and len(q) else []
        return found[0] if found else pd.DataFrame({"query": q["query"][:0], "label": p["label"][:0], "id": p["id"][:0], "score": np.zeros(0)})

    ranked = parts.groupBy("label", "chunk").cogroup(told.groupBy("label", "chunk")).applyInPandas(best, f"query {kinds['query']}, label string, id {kinds['id']}, score double")
    ranked = top(ranked, ["query", "label"], [F.desc("score"), "id"], k)
    if not equal:
        return ranked
    own = whole.select("label", "text", F.col("id").alias("least")).join(firsts.select("label", "text", "id"), ["label", "text"])
    found = ranked.withColumnRenamed("id", "least").join(own, ["label", "least"]).select("query", "label", "id", "score")
    return top(found, ["query", "label"], [F.desc("score"), "id"], k)


def _best_of(p: pd.DataFrame, q: pd.DataFrame, k: int, least: float, digits: int) -> pd.DataFrame:
    """The k best of one chunk: p (label, id, term, part) of one label, q (query, term). Parts are whole billionths, whose sums
    are exact in double."""
    ids, doc = np.unique(p["id"].to_numpy(), return_inverse=True)
    code, names = pd.factorize(p["term"])
    order = np.argsort(code, kind="stable")
    doc, part, count = doc[order], p["part"].to_numpy()[order].astype(np.float64), np.bincount(code, minlength=len(names))
    start = np.cumsum(count) - count
    asks, who = np.unique(q["query"].to_numpy(), return_inverse=True)
    term = pd.Index(names).get_indexer(q["term"])
    who, term = who[term >= 0], term[term >= 0]
    step, out = max(1, CELLS // len(ids)), []
    for low in range(0, len(asks), step):
        own = (who >= low) & (who < low + step)
        w, t = who[own] - low, term[own]
        n, rows = count[t], min(step, len(asks) - low)
        at = np.arange(n.sum()) + np.repeat(start[t] - (np.cumsum(n) - n), n)  # places of all postings of the terms
        cell = np.repeat(w, n) * len(ids) + doc[at]
        total = np.bincount(cell, part[at], rows * len(ids)).reshape(rows, -1)
        hit = total > 0 if least >= 0 else np.bincount(cell, minlength=rows * len(ids)).reshape(rows, -1) > 0
        score = np.where(hit, np.floor(total / 1e9 * 10.0**digits + 0.5) / 10.0**digits, -np.inf)
        hit &= score > least
        if len(ids) > k:
            hit &= score >= np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
        row, col = np.nonzero(hit)
        out.append(pd.DataFrame({"query": asks[row + low], "id": ids[col], "score": score[row, col], "row": row + low}))
    found = pd.concat(out).sort_values(["row", "score", "id"], ascending=[True, False, True], kind="stable")
    found = found[found.groupby("row").cumcount() < k]
    return found.assign(label=p["label"].iloc[0])[["query", "label", "id", "score"]]


def by_exact_name(entities: DataFrame, cues: DataFrame) -> DataFrame:
    """(cue, entity): equal names, the least id where several match."""
    return cues.join(entities, F.col("text") == F.col("name")).groupBy("cue").agg(F.min("entity").alias("entity"))


def by_name_ci(entities: DataFrame, cues: DataFrame) -> DataFrame:
    return cues.select("cue", F.lower("text").alias("_n")).join(entities, F.lower("name") == F.col("_n")).select("cue", "entity")


#: Longest grams of names.
GRAM = 3


def _grams(c: Column, q: int) -> Column:
    """All runs of q characters."""
    return F.when(F.length(c) >= q, F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(c, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


class NameGrams:
    """Postings of the runs of up to GRAM characters of the distinct lower-case names, saved once for many lookups.

    postings: (gram, name); counts: (gram, names)."""

    def __init__(self, entities: DataFrame, least: int = 2):
        self.least = least
        names = entities.where("name is not null").select(F.lower("name").alias("name")).distinct()
        runs = F.array_distinct(F.flatten(F.array(*[_grams(F.col("name"), q) for q in range(min(least, GRAM), GRAM + 1)])))
        self.postings = saved(names.select(F.explode(runs).alias("gram"), "name"), "grams")
        self.counts = self.postings.groupBy("gram").agg(F.count("*").alias("names"))

    def containing(self, parts: DataFrame) -> DataFrame:
        """(part, name): lower-case names that contain each part (a column part, lower-case and distinct).

        A part is looked up by its rarest gram only, and what that finds is compared; a gram that no name has
        ends the lookup. Parts shorter than `least` find nothing."""
        parts = parts.where(F.length("part") >= self.least)
        grams = _grams(F.col("part"), GRAM)
        for q in range(GRAM - 1, 0, -1):
            grams = F.when(F.length("part") == q, F.array("part")).otherwise(grams)
        asked = parts.select("part", F.explode(F.array_distinct(grams)).alias("gram")).join(self.counts, "gram", "left")
        rarest = asked.groupBy("part").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("g")).where("g.names > 0").select("part", "g.gram")
        return rarest.join(self.postings, "gram").where(F.contains("name", "part")).select("part", "name")


def by_partial_name(entities: DataFrame, cues: DataFrame, least: int = 2, grams: NameGrams | None = None) -> DataFrame:
    """(cue, entity): entities whose name contains the cue, whatever its case. Distinct texts meet distinct names
    by their rarest gram; several texts a cue give an entity once each."""
    grams = grams or NameGrams(entities, least)
    texts = cues.where(F.length("text") >= least).select("cue", F.lower("text").alias("part"))
    hit = grams.containing(texts.select("part").distinct())
    return texts.join(hit, "part").join(entities.select("entity", F.lower("name").alias("name")), "name").select("cue", "entity")


def seeds(entities: DataFrame, cues: DataFrame, n: int = 5, index: Index | DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(cue, entity, confidence): the best of six lookups, the first n of each cue.

    Text index (or texts (label, id, text) to search once), exact and case-insensitive names 1.0; a token as a name .85; a part .7; a token as a part
    .6; vectors (cue, entity, similarity) from .4 at their similarity. Tokens have three letters or more.
    """
    words = cues.select("cue", F.explode(F.array_distinct(F.filter(terms(F.col("text")), lambda t: F.length(t) >= 3))).alias("text"))
    first = top(entities.where("name is not null").select(F.lower("name").alias("name"), "entity").distinct(), ["name"], ["entity"], n)  # equal names weigh alike: no other can be among n
    known, grams, named = first.select("name").distinct(), NameGrams(entities), None
    for texts, whole, part in ((cues, 1.0, 0.7), (words, 0.85, 0.6)):
        low = texts.select("cue", F.lower("text").alias("part")).where("part is not null").distinct()
        same = low.select("cue", F.col("part").alias("name")).join(known, "name", "left_semi").select("cue", "name", F.lit(whole).alias("confidence"))
        held = low.join(grams.containing(low.select("part").distinct()), "part").select("cue", "name", F.lit(part).alias("confidence"))
        named = same.unionByName(held) if named is None else named.unionByName(same).unionByName(held)
    found = named.groupBy("cue", "name").agg(F.max("confidence").alias("confidence")).join(first, "name").select("cue", "entity", "confidence")
    if index is not None:
        asked = cues.withColumnRenamed("cue", "query")
        hits = search_once(index, asked, n, equal=True) if isinstance(index, DataFrame) else index.search(asked, n)
        found = found.unionByName(hits.select(F.col("query").alias("cue"), F.col("id").alias("entity"), F.lit(1.0).alias("confidence")))
    if vectors is not None:
        found = found.unionByName(vectors.where("similarity >= 0.4").select("cue", "entity", F.col("similarity").alias("confidence")))
    return top(found.groupBy("cue", "entity").agg(F.max("confidence").alias("confidence")), ["cue"], [F.desc("confidence"), "entity"], n)


def nearest(items: DataFrame, queries: DataFrame, k: int = 10, least: float = -1e300, unit: bool = True, digits: int = 6, bound: int = BLOCK) -> DataFrame:
    """(query, id, similarity): the k most similar items (id, vector) of each query (query, vector), by inverted
    lists that are built here, or without lists for few queries; searches that share items should build a VectorIndex
    once. bound: rows of a block."""
    queries = saved(queries, "queries")
    if unit and queries.count() <= FEW_QUERIES:
        return VectorIndex.plain(items, min(bound, TILE)).search(queries, k, least, digits)
    return VectorIndex.build(items, unit, block=bound).search(queries, k, least, digits)


def embed_missing(texts: DataFrame, cache: DataFrame, model: Callable) -> DataFrame:
    """New cache rows (hash, vector) of distinct texts the cache lacks; model is a pandas_udf of text."""
    new = texts.select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")
    return new.select("hash", model("text").alias("vector"))


def supersedes_target(cues: DataFrame, atoms: DataFrame, least: float = 0.55) -> DataFrame:
    """(query, id): a cue that is an id passes through, else its most similar atom from `least` on."""
    ids = cues.where(F.col("text").rlike("^[0-9A-HJKMNP-TV-Z]{26}$")).select("query", F.col("text").alias("id"))
    rest = cues.where(~F.col("text").rlike("^[0-9A-HJKMNP-TV-Z]{26}$"))
    return ids.union(nearest(atoms, rest, 1, least).select("query", F.col("id").cast("string").alias("id")))
