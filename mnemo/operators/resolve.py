"""Entity resolution: person linking, fit scores, decision zones, extraction writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.operators.frames import dealt, saved, top
from mnemo.operators.search import Index
from mnemo.operators.vectors import VectorIndex
from mnemo.plans.spec import GENERAL, GraphSpec


def link_persons(persons: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(canonical, person_key, display_name): keys `source:username` of one username meet in person:<username>
    if there are two or more; manual rows (canonical, person_key) are added. The display name is the least
    that is not the key itself."""
    p = persons.select("person_key", "display_name", F.regexp_extract("person_key", r"^[^:]+:(.*)$", 1).alias("username")).where("username <> ''")
    best = F.coalesce(F.min(F.when(F.col("display_name") != F.col("person_key"), F.col("display_name"))), F.min("display_name"))
    g = p.groupBy("username").agg(best.alias("display_name"), F.count_distinct("person_key").alias("n")).where("n >= 2")
    out = g.join(p.select("username", "person_key").distinct(), "username").select(F.concat(F.lit("person:"), "username").alias("canonical"), "person_key", "display_name")
    if manual is not None:
        out = out.unionByName(manual.join(persons.groupBy("person_key").agg(F.min("display_name").alias("display_name")), "person_key", "left").select("canonical", "person_key", "display_name"))
    return out.distinct()


def candidates(names: DataFrame, entities: DataFrame, index: Index | None = None, vectors: VectorIndex | None = None, mention_vectors: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(mention, entity, weight): up to n entities that each name (mention, name, type) may mean, from four indexes.

    entities: (entity, name[, aliases, last_seen]). Equal names, whatever their case and type, weigh 1, aliases
    .9, text matches up to .8 in proportion to the name's best score, vectors from .4 their similarity; the
    greatest weight of an entity counts. Names are looked up once each, however many mentions they have,
    and entities of one name are cut to the n last seen before they meet mentions, so a name that a third of
    all entities bear gives each mention n rows. A missing name or vector finds nothing."""
    low = F.lower("name").alias("text")
    texts = names.where("name is not null").select(low).distinct()
    seen = F.col("last_seen") if "last_seen" in entities.columns else F.lit(0)
    order = [F.desc_nulls_last("seen"), "entity"]
    same = top(entities.select(low, "entity", seen.alias("seen")), ["text"], order, n)
    found = same.join(texts, "text", "left_semi").select("text", "entity", F.lit(1.0).alias("weight"))
    if "aliases" in entities.columns:
        other = top(entities.select(F.explode("aliases").alias("name"), "entity", seen.alias("seen")).select(low, "entity", "seen").distinct(), ["text"], order, n)
        found = found.union(other.join(texts, "text", "left_semi").select("text", "entity", F.lit(0.9)))
    if index is not None:
        hit = index.search(texts.select(F.col("text").alias("query"), "text"), n)
        best = hit.groupBy("query").agg(F.max("score").alias("best"))
        found = found.union(hit.join(best, "query").select("query", F.col("id").alias("entity"), F.round(0.8 * F.col("score") / F.col("best"), 6)))
    few = top(found.groupBy("text", "entity").agg(F.max("weight").alias("weight")), ["text"], [F.desc("weight"), "entity"], n)
    out = names.where("name is not null").select("mention", low).join(few, "text").select("mention", "entity", "weight")
    if vectors is not None:
        near = vectors.search(mention_vectors.select(F.col("mention").alias("query"), "vector"), n, 0.4, same="keep")
        out = out.union(near.select("query", "id", "similarity"))
    out = dealt(out, n * names.count(), "mention")  # hardly any of them combine
    return top(out.groupBy("mention", "entity").agg(F.max("weight").alias("weight")), ["mention"], [F.desc("weight"), "entity"], n)


def fit(pairs: DataFrame, spec: GraphSpec, as_of: Column) -> DataFrame:
    """pairs: mention, name, type, entity, entity_name, entity_type, last_seen, overlap, place. Two names are compared
    once, however many pairs have them; Spark's size check of the saved comparisons decides how they meet pairs."""
    pairs = saved(pairs, "pairs")
    names = pairs.select("name", "entity_name").distinct()
    alike = saved(names.select(F.col("name").alias("_a"), F.col("entity_name").alias("_b"), T.name_similarity(F.col("name"), F.col("entity_name")).alias("_alike")), "alike")
    pairs = pairs.join(alike, F.col("name").eqNullSafe(F.col("_a")) & F.col("entity_name").eqNullSafe(F.col("_b"))).drop("_a", "_b")
    parts = {
        "name": F.col("_alike"),
        "recency": T.linear_recency(as_of, F.col("last_seen")),
        "context": F.col("overlap"),
        "type": T.type_match(F.col("type"), F.col("entity_type")),
        "place": F.col("place").cast("double"),
    }
    return pairs.withColumn("fit", F.round(T.weighted_mean(parts, spec.weights), 6)).drop("_alike")


def resolve(names: DataFrame, entities: DataFrame, pairs: DataFrame, as_of: Column, spec: GraphSpec = GENERAL) -> DataFrame:
    """(mention, entity, decision, fit) for names (mention, name, type): exact name and type at once; else the
    best fit decides: accept, suspect (a new entity with an alias edge to the found one) or new. Names are
    resolved against the snapshot; new names of one batch that are equal but for case share one new id."""
    first = entities.groupBy(F.col("name").alias("_n"), F.col("type").alias("_t")).agg(F.min("id").alias("entity"))  # a row a name and type, however many bear it
    exact = names.join(first, (F.col("name") == F.col("_n")) & (F.col("type") == F.col("_t"))).groupBy("mention").agg(F.min("entity").alias("entity"))
    rest = names.join(exact, "mention", "left_anti")
    best = top(fit(pairs, spec, as_of), ["mention"], [F.desc("fit"), "entity"], 1).select("mention", F.col("entity").alias("near"), "fit")
    new_id = T.content_id(F.concat_ws("|", F.lower("name"), "type"), 26)
    x = rest.join(best, "mention", "left")
    decision = F.when(F.col("fit") >= spec.accept, "accept").when(F.col("fit") >= spec.uncertain, "suspect").otherwise("new")
    scored = x.withColumn("decision", decision).select("mention", F.when(F.col("decision") == "accept", F.col("near")).otherwise(new_id).alias("entity"), "decision", "fit", F.when(F.col("decision") == "suspect", F.col("near")).alias("alias_of"))
    return exact.select("mention", "entity", F.lit("exact").alias("decision"), F.lit(1.0).alias("fit"), F.lit(None).cast("string").alias("alias_of")).unionByName(scored)


def extraction_writes(extractions: DataFrame, resolved: DataFrame, atoms: DataFrame) -> dict[str, DataFrame]:
    """Model output (atom, mention, name, type, prominence) to mentions, association bumps, entity bumps and
    the atoms that are now extracted. Blank names are dropped, a missing prominence is 0.5."""
    x = extractions.where(F.trim("name") != "").join(resolved.select("mention", "entity"), "mention")
    m = x.groupBy("atom", "entity").agg(F.max(F.coalesce("prominence", F.lit(0.5))).alias("prominence")).join(atoms.select("atom", "created_at"), "atom")
    pairs = m.select("atom", F.col("entity").alias("a"), "created_at").join(m.select("atom", F.col("entity").alias("b")), "atom").where("a < b")
    return {
        "mentions": m,
        "assoc": pairs.groupBy("a", "b").agg(F.count("*").alias("weight"), F.max("created_at").alias("last_reinforced")),
        "entity_bumps": m.groupBy("entity").agg(F.count("*").alias("mention_count"), F.max("created_at").alias("last_seen")),
        "extracted": m.select("atom").distinct(),
        "aliases": resolved.where("alias_of is not null").select(F.col("entity").alias("a"), F.col("alias_of").alias("b"), F.col("fit").alias("confidence"), F.lit("suspected").alias("status")).distinct(),
    }


def due(atoms: DataFrame, attempts: DataFrame, as_of: Column, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Unextracted atoms whose next attempt is due, oldest first in a batch, and those given up."""
    x = atoms.where("not extracted").join(attempts, "atom", "left")
    n = F.coalesce("attempts", F.lit(0))
    return x.where((n < most) & (F.coalesce("next_at", as_of) <= as_of)), x.where(n >= most)


def next_attempt(n: Column, as_of: Column, base_seconds: int = 2) -> Column:
    return as_of + F.make_dt_interval(secs=(F.pow(F.lit(2.0), n) * base_seconds).cast("decimal(18,6)"))
