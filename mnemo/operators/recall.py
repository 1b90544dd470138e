"""Recall queries: associate, working memory, episodes, context packets, access log folding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions.text import access_saturation, fact_sentence, recall_recency, salience_weight, snippet, tier_weight
from mnemo.operators import graph, search
from mnemo.operators.frames import between, clamp, dealt, only, saved, top, within_budget


def tier(created: Column, accesses: Column, as_of: Column) -> Column:
    """hot: a week old at most or read three times; cold: over 90 days old and read less than twice; else warm."""
    return F.when((created >= as_of - F.expr("INTERVAL 7 DAYS")) | (accesses >= 3), "hot").when((created < as_of - F.expr("INTERVAL 90 DAYS")) & (accesses < 2), "cold").otherwise("warm")


def working_memory(atoms: DataFrame, scope: list, order: str = "last_accessed", limit: int = 20, newest: bool = True) -> DataFrame:
    """The last used atoms of each scope."""
    return top(atoms, scope, [F.desc_nulls_last(order) if newest else F.asc_nulls_last(order), "atom"], clamp(limit, 1, 50))


def associate(cues: DataFrame, entities: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], mentions: DataFrame, atoms: DataFrame | Callable[[DataFrame], DataFrame], as_of: Column, limit: int = 30, n_seeds: int = 5, n_spread: int = 30, seeds: DataFrame | None = None, index: search.Index | DataFrame | None = None, vectors: DataFrame | None = None, saturate: bool = False) -> DataFrame:
    """(cue, atom, score, matches): cue -> seeds -> two-hop spread -> atoms that mention what is active.

    score = sum(prominence * activation) * recency * salience * tier; atoms carry created_at, salience,
    tier. Cues meet few entities and atoms of large tables, so edges may be a function (see spread_activation) and so
    may atoms, of distinct keys (atom); mentions are cut to active entities before they are grouped or joined.
    A text index of entity names, or the names (label, id, text) if they are searched only this once, and vectors
    (cue, entity, similarity) add to the seeds; with saturate the score is damped by access_count, so that atoms
    that are read often do not stay in front for that alone.
    """
    s = seeds if seeds is not None else search.seeds(entities, cues, n_seeds, index, vectors)
    active = saved(graph.spread_activation(edges, s.withColumnRenamed("confidence", "activation"), 2, 0.5, n_spread), "active")
    part = F.round(F.coalesce(F.col("prominence").cast("double"), F.lit(0.5)) * F.col("activation"), 9).cast("decimal(20,9)")
    raw = saved(only(mentions, active, "entity").join(active, "entity").groupBy("cue", "atom").agg(F.sum(part).cast("double").alias("raw"), F.count_distinct("entity").alias("matches")), "raw")
    scored = raw.join(atoms if isinstance(atoms, DataFrame) else atoms(raw.select("atom").distinct()), "atom").withColumn("score", F.round(F.col("raw") * recall_recency(as_of, F.col("created_at")) * salience_weight(F.col("salience")) * tier_weight(F.col("tier")) * (access_saturation(F.coalesce("access_count", F.lit(0))) if saturate else F.lit(1.0)), 6))
    return top(scored, ["cue"], [F.desc("score"), "atom"], clamp(limit, 1, 30)).select("cue", "atom", "score", "matches")


def recall_episode(atoms: DataFrame, start=None, end=None, kinds: list | None = None, where: DataFrame | None = None, limit: int = 50, overfetch: int = 3, activation: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """Atoms of a span in order of time; with activation (entity, activation) the fetched ones are ranked
    anew by what they mention. Superseded atoms are included."""
    out = between(only(atoms, where, "cwd") if where is not None else atoms, "created_at", start, end)
    out = out if kinds is None else out.where(F.col("kind").isin(kinds))
    limit = clamp(limit, 1, 50)
    if activation is None:
        return out.orderBy("created_at", "atom").limit(limit)
    out = out.orderBy("created_at", "atom").limit(limit * overfetch)
    gain = mentions.join(activation, "entity").groupBy("atom").agg(F.sum(F.col("prominence") * F.col("activation")).alias("score"))
    return out.join(gain, "atom", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), "created_at", "atom").limit(limit)


def fold_accesses(atoms: DataFrame, accesses: DataFrame, warm: float = 0.3, hot: float = 0.5) -> DataFrame:
    """Reads of atoms folded in time order: access_count, last_accessed and tier, promoted one step a read
    (cold to warm from weight `warm`, warm to hot from `hot`, which is no less).

    A cold atom is hot if a read of `hot` follows its first read of `warm`: if there are two reads of `hot`, or
    one that is not the first of `warm`. So minima, maxima and counts say it, and a hot atom's reads are
    combined before the shuffle."""
    at = F.struct("ts", "weight")
    log = accesses.groupBy("atom").agg(
        F.count("*").alias("reads"),
        F.max("ts").alias("last_accessed"),
        F.min(F.when(F.col("weight") >= warm, at)).alias("_warm"),
        F.max(F.when(F.col("weight") >= hot, at)).alias("_hot"),
        F.count_if(F.col("weight") >= hot).alias("_n"),
    )
    out = atoms.join(log, "atom", "left")
    cold = F.when((F.col("_n") >= 2) | (F.col("_hot") > F.col("_warm")), "hot").when(F.col("_warm").isNotNull(), "warm").otherwise("cold")
    tier = F.when(F.col("tier") == "hot", "hot").when(F.col("tier") == "warm", F.when(F.col("_n") > 0, "hot").otherwise("warm")).otherwise(cold)
    return out.select("atom", F.coalesce("reads", F.lit(0)).alias("reads"), "last_accessed", tier.alias("tier"))


def co_retrieval(accesses: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pairs a < b of entities that read atoms mention, with one more weight a read: bumps for the edges."""
    n = accesses.groupBy("atom").agg(F.count("*").alias("n"))
    m = mentions.select("atom", "entity").distinct().join(n, "atom")
    return m.select("atom", F.col("entity").alias("a"), "n").join(m.select("atom", F.col("entity").alias("b")), "atom").where("a < b").groupBy("a", "b").agg(F.sum("n").alias("weight"))


def bump(edges: DataFrame, more: DataFrame, rows: int | None = None) -> DataFrame:
    """Associations with weights added, pairs in canonical order, self pairs dropped. Dealt as for so many rows, if
    that is given."""
    both = edges.select("a", "b", "weight").union(more.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight"))
    return dealt(both, rows, "a", "b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def context_packet(queries: DataFrame, index: search.Index, touches: DataFrame, activities: DataFrame, edges: DataFrame, start=None, end=None, n_anchors: int = 5, least: float = 0.3, limit: int = 20, budget: int = 8000) -> dict[str, DataFrame]:
    """Anchors, facts, evidence and graph slice of each query, as four tables that share the anchors.

    touches: (activity, label, node) with nodes named as the index names ids; activities: (activity, ts, snippet).
    """
    anchors = saved(index.search(queries, n_anchors, least, n_anchors), "anchors")
    roots = anchors.select(F.col("id").alias("node"), "label").distinct()
    rel = graph.related(touches, roots)
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("paths")).alias("p"), "other"))), lambda x: x["other"].cast("string"))
    facts = rel.groupBy("seed", "activities").agg(names.alias("related")).select("seed", fact_sentence(F.col("seed").cast("string"), F.col("activities"), F.col("related")).alias("fact"))
    near = anchors.select("query", F.col("id").alias("node")).join(touches, "node").select("query", "activity").distinct()
    evidence = within_budget(between(near.join(activities, "activity"), "ts", start, end).withColumn("snippet", snippet(F.col("snippet"))), ["query"], [F.desc("ts"), "activity"], "snippet", budget, limit)
    slice_ = graph.neighborhood(edges, roots.select(F.col("node").alias("root")), "in", None, 40)
    return {"anchors": anchors, "facts": anchors.select("query", F.col("id").alias("seed")).join(facts, "seed"), "evidence": evidence, "slice": slice_}


def people_context(queries: DataFrame, index: search.Index, activities: DataFrame, start=None, end=None) -> DataFrame:
    """The top person of each query with counts a container: (query, person, container, n, latest)."""
    one = index.search(queries, 1, 0.0, 1).select("query", F.col("id").alias("person"))
    return one.join(between(activities, "ts", start, end), "person").groupBy("query", "person", "container").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def meetings(activities: DataFrame, start, end, kinds: list, source: str) -> DataFrame:
    """Activities of meeting kinds in a window; if there are none at all, those of the calendar source."""
    w = between(activities, "ts", start, end)
    main = w.where(F.col("kind").isin(kinds))
    any_ = main.limit(1).select(F.lit(1).alias("_any"))
    fallback = w.where(F.col("source") == source).join(F.broadcast(any_), F.lit(True), "left_anti")
    return main.union(fallback)


def log_of_kinds(activities: DataFrame, kinds: list, start, end, by: list, limit: int = 20, budget: int = 8000) -> DataFrame:
    """The newest activities of some kinds, a budget a group: decision log, change summary by repository."""
    return within_budget(between(activities, "ts", start, end).where(F.col("kind").isin(kinds)), by, [F.desc("ts"), "source_id"], "snippet", budget, limit)


def change_summary(activities: DataFrame, repo: str, start, end, kinds: list, impacts: DataFrame | None = None, snippet_chars: int = 300, limit: int = 20, budget: int = 8000, processes: int = 5) -> DataFrame:
    """The newest changes of each repository with snippets cut to some characters, within a budget a repository; with
    impacts (change, process, hits) also the processes that a change reaches most, as rows: (repo, source_id,
    ts, snippet, process, hits), null where none is known. Hits of a change and process are added up."""
    x = activities.withColumn("snippet", snippet(F.col("snippet"), snippet_chars)).withColumnRenamed(repo, "repo")
    new = log_of_kinds(x, kinds, start, end, ["repo"], limit, budget).select("repo", "source_id", "ts", "snippet")
    if impacts is None:
        return new.withColumn("process", F.lit(None).cast("string")).withColumn("hits", F.lit(None).cast("long"))
    sums = impacts.join(new.select(F.col("source_id").alias("change")), "change", "left_semi").groupBy("change", "process").agg(F.sum("hits").alias("hits"))
    best = top(sums, ["change"], [F.desc("hits"), "process"], processes)
    return new.join(best, F.col("source_id") == F.col("change"), "left").drop("change")


def hits_by(impacts: DataFrame, name: str, n: int = 15) -> DataFrame:
    return impacts.groupBy(name).agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), name).limit(n)


def across_instances(run, tables: dict, **args) -> DataFrame:
    """The same query on each instance's tables, unioned with a column instance; a failing one is left out. Each is
    run and saved by itself, so that errors of its tasks are isolated too, not only those of its plan."""
    out = None
    for name, t in tables.items():
        try:
            one = saved(run(t, **args), "instance").withColumn("instance", F.lit(name))
        except Exception:  # noqa: BLE001  partial results are the contract of a fan-out
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def children_for(queries: DataFrame, instances: DataFrame) -> DataFrame:
    """(query, instance): active instances whose description matches, else all active ones. Every query
    without a match meets every active instance, in one pass over the instances: those queries are counted
    and broadcast up to 10,000."""
    act = instances.where("status = 'active'")
    idx = search.Index.build(act.select(F.lit("instance").alias("label"), F.col("name").alias("id"), F.col("description").alias("text")))
    hit = idx.search(queries, 2**31 - 1).select("query", F.col("id").alias("instance"))
    rest = queries.join(hit, "query", "left_anti").select("query", F.lit("active").alias("status"))
    rest = F.broadcast(rest) if rest.count() <= 10_000 else rest
    return hit.union(act.join(rest, "status").select("query", F.col("name").alias("instance")))


def answer(requests: DataFrame, by_type: dict) -> DataFrame:
    """Requests (query, type, text) answered by type: {type: function of its requests} to one tagged union."""
    out = None
    for kind, run in by_type.items():
        one = run(requests.where(F.col("type") == kind)).withColumn("type", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def collected(sources: dict) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of what several readers give, and the errors of those that failed, in their plan or when they ran:
    what each gives is saved before it is united."""
    out, errors = None, {}
    for name, read in sources.items():
        try:
            one = saved(read(), "source")
        except Exception as e:  # noqa: BLE001  one failing source must not stop the others
            errors[name] = str(e)[:300]
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out, errors
