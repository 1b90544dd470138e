import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.operators import clinical, frames, graph, maintain, portfolio, recall, research, resolve, search, sinks
from mnemo.plans import catalogue, registry, spec

AS_OF = "2024-06-01 00:00:00"


def ts(s):
    return F.lit(s).cast("timestamp")


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


@pytest.fixture(scope="module")
def memory(spark):
    m = spark.createDataFrame([("a1", "B", 0.9), ("a1", "K", 0.7), ("a2", "B", 0.9), ("a2", "M", 0.8), ("a3", "K", 0.8), ("a3", "A", 0.6), ("a4", "A", 0.7), ("a4", "B", 0.9)], "atom string, entity string, prominence double")
    e = spark.createDataFrame([("A", "Anna", "person"), ("B", "Brainbox", "project"), ("K", "Kuzco", "tool"), ("M", "MCX", "tool")], "entity string, name string, type string")
    assoc = spark.createDataFrame([("B", "K", 1), ("B", "M", 1), ("A", "K", 1), ("A", "B", 1)], "a string, b string, weight int")
    atoms = spark.createDataFrame([(a, AS_OF, "normal", "hot", "/tmp/a") for a in ("a1", "a2", "a3")] + [("a4", AS_OF, "normal", "hot", "/tmp/b")], "atom string, created_at string, salience string, tier string, cwd string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return m, e, assoc, atoms


def test_mentions_and_spread(spark, memory):
    m, e, assoc, atoms = memory
    top = graph.mentioning_atoms(m, spark.createDataFrame([("B",), ("K",)], "entity string")).orderBy(F.desc("score")).first()
    assert (top.atom, round(top.score, 6), top.matches) == ("a1", 1.6, 2)
    seeds = lambda x: spark.createDataFrame([(1, x, 1.0)], "cue int, entity string, activation double")
    got = {r.entity: r.activation for r in graph.spread_activation(assoc, seeds("B"), 1).collect()}
    assert got == {"B": 1.0, "K": 0.125, "M": 0.125, "A": 0.125}
    two = {r.entity: r.activation for r in graph.spread_activation(assoc, seeds("M"), 2).collect()}
    assert set(two) == {"A", "B", "K", "M"} and two["M"] == 1.0 and max(two.values()) <= 1.0
    assert graph.spread_activation(assoc, seeds("B").limit(0)).count() == 0
    assert graph.induced(assoc, graph.spread_activation(assoc, seeds("B"), 1)).count() == 4
    cues = spark.createDataFrame([(1, "brainbox"), (2, "ann"), (3, "zz")], "cue int, text string")
    got = recall.associate(cues, e, assoc, m, atoms, ts(AS_OF)).collect()
    assert {r.cue for r in got} == {1, 2} and [r.atom for r in got if r.cue == 2][0] in ("a3", "a4")


def test_walks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src int, dst int")
    roots = spark.createDataFrame([(1,)], "root int")
    assert {(r.node, r.kind, r.depth) for r in graph.impact(e, roots, 3).collect()} == {(2, "downstream", 1), (3, "downstream", 2), (4, "downstream", 3), (9, "dependent", 1)}
    k = e.withColumn("kind", F.lit("R"))
    assert {r.neighbour for r in graph.neighborhood(k, roots, "in").collect()} == {3, 9}
    assert {r.neighbour for r in graph.neighborhood(k, roots, "both").collect()} == {2, 3, 9}
    u = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(1).alias("weight"))
    assert {(r.node, r.depth) for r in graph.network(u, roots, 2).collect()} == {(1, 0), (2, 1), (3, 1), (9, 1), (4, 2)}


def test_names_and_recency(spark):
    sim = lambda a, b: one(spark, T.name_similarity(F.lit(a), F.lit(b)))
    assert sim("Anna", "Anna") == sim("anna", "Anna") == pytest.approx(1)
    assert 0.4 < sim("Anna", "Anna Smith") < 1 and sim("Anna", "Robert") < 0.25 and 0.15 < sim("Zuku", "Zukku") < 0.4 and sim("", "Anna") == 0 and sim("Code Bench", "Code Bench CLI") > 0.5
    rec = lambda d: one(spark, T.linear_recency(ts(AS_OF), ts(AS_OF) - F.expr(f"INTERVAL {d} DAYS")))
    assert rec(0) >= 0.99 and rec(365) < 0.05 and rec(730) == 0 and 0.4 < rec(180) < 0.6 and one(spark, T.linear_recency(ts(AS_OF), F.lit(None).cast("timestamp"))) == 0


def test_tiers(spark):
    for days, n, want in ((1, 0, "hot"), (30, 0, "warm"), (200, 0, "cold"), (200, 2, "warm"), (365, 5, "hot")):
        assert one(spark, recall.tier(ts(AS_OF) - F.expr(f"INTERVAL {days} DAYS"), F.lit(n), ts(AS_OF))) == want
    a = spark.createDataFrame([(1, "cold"), (2, "warm"), (3, "cold")], "atom int, tier string")
    log = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.6), (1, 3, 0.1), (2, 1, 0.4)], "atom int, ts int, weight double")
    assert {(r.atom, r.reads, r.tier) for r in recall.fold_accesses(a, log).collect()} == {(1, 3, "hot"), (2, 1, "warm"), (3, 0, "cold")}
    assert {(r.tier, r.delta) for r in maintain.tier_changes(a, F.lit("hot")).collect()} == {("cold", -2), ("warm", -1), ("hot", 3)}


def test_text_functions(spark):
    assert one(spark, T.slugify(F.lit("  Foo_Bar -- Baz! "))) == "foo-bar-baz"
    assert one(spark, T.strip_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"
    assert one(spark, T.leading_number(F.lit("7.2 mg"))) == 7.2 and one(spark, T.leading_number(F.lit("x"))) is None
    assert one(spark, T.json_candidate(F.lit('Sure:\n```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(spark, T.json_candidate(F.lit("see [1, 2] ok"))) == "[1, 2]" and one(spark, T.json_candidate(F.lit("none"))) is None
    assert one(spark, T.topics_line(F.lit("x\nTopics: A, b ,A"))) == ["a", "b"]
    assert one(spark, T.age_years(F.lit("2000-02-29").cast("date"), F.lit("2023-02-28").cast("date"))) == 22
    assert one(spark, T.snippet(F.lit("x" * 2001))) == "x" * 2000 + "…"
    assert one(spark, T.health_label(F.lit(80), F.lit(1), F.lit(1))) == "excellent"


def test_search(spark):
    texts = spark.createDataFrame([("p", 1, "Alice Test"), ("p", 2, "Bob"), ("t", 1, "deploy deploy notes"), ("t", 2, "deploy")], "label string, id int, text string")
    q = spark.createDataFrame([(1, "alice"), (2, "deploy"), (3, "nothing")], "query int, text string")
    got = search.Index.build(texts).search(q, 5).collect()
    assert {(r.query, r.label, r.id) for r in got} == {(1, "p", 1), (2, "t", 1), (2, "t", 2)}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [1.0])], "id int, vector array<float>")
    near = search.nearest(v, v.withColumnRenamed("id", "query"), 1, 0.1).collect()
    assert {(r.query, r.id) for r in near} == {(1, 2), (2, 1)}
    assert {r.id for r in search.nearest(v, v.withColumnRenamed("id", "query"), 1, 0.1, bound=1).collect()} == {1, 2}
    c = spark.createDataFrame([("x", "Q" * 26, [0.0, 1.0]), ("y", "like one", [1.0, 0.1])], "query string, text string, vector array<float>")
    a = v.select(F.col("id").cast("string").alias("id"), "vector")
    assert {(r.query, r.id) for r in search.supersedes_target(c, a).collect()} == {("x", "Q" * 26), ("y", "1")}


def test_clinical(spark):
    d = lambda s: None if s is None else dt.date.fromisoformat(s)
    p = spark.createDataFrame([(1, d("1980-01-15"), "M"), (2, d("1975-06-20"), "F")], "patient int, birth date, gender string")
    dx = spark.createDataFrame([(1, "Diabetes mellitus type 2", d("2023-01-10"), None), (1, "Hypertension", d("2023-03-15"), d("2023-06-01")), (2, "Diabetes mellitus type 2", d("2023-02-01"), None)], "patient int, condition string, start date, stop date")
    rx = spark.createDataFrame([(1, "Metformin 500 MG", d("2023-01-10"), d("2023-01-20"), 1, 1), (1, "Metformin 500 MG", d("2023-02-01"), None, 1, 2)], "patient int, drug string, start date, stop date, encounter int, line int")
    labs = spark.createDataFrame([(1, "hba1c", d("2023-01-10"), 7.2, 1), (1, "hba1c", d("2023-03-15"), 6.8, 2), (2, "hba1c", d("2023-01-01"), 5.0, 3)], "patient int, code string, date date, value double, id int")
    assert clinical.cohort(p, dx, rx, ["diabetes"]).count() == 2 and clinical.cohort(p, dx, rx, ["diabetes", "HYPERTENSION"]).count() == 1
    assert clinical.cohort(p, dx, rx, [], ["metformin"]).count() == 1
    as_of = F.lit("2024-01-01").cast("date")
    assert clinical.cohort(p, dx, rx, ages=(45, 60), as_of=as_of).first().patient == 2
    assert clinical.diagnoses(dx, p.where("patient = 1"), "active").count() == 1 and clinical.diagnoses(dx, p.where("patient = 1"), "resolved").count() == 1
    ev = lambda c: dx.where(F.startswith("condition", F.lit(c))).select("patient", F.col("start").alias("date"))
    assert clinical.temporal_relation(ev("Diab"), rx.select("patient", F.col("start").alias("date"))).first().relation == "same_day"
    assert clinical.temporal_relation(ev("Diab"), ev("Hyp")).first().relation == "before"
    c = {r.patient: r for r in clinical.compare(labs).collect()}
    assert (c[1].delta, c[1].direction, c[1].days) == (-0.4, "falling", 64) and c[2].direction == "stable"
    near = clinical.compare(labs, F.lit("2023-03-01").cast("date"), F.lit("2023-03-30").cast("date")).where("patient = 1").first()
    assert near["first"] == near["last"] == 6.8
    (g,) = clinical.aggregate_observation(labs, p).collect()
    assert (g.avg, g.min, g.max, g.n, g.median) == (5.9, 5.0, 6.8, 2, 5.9)
    assert [(r.label, r.n) for r in clinical.distribution(labs, p, [5, 6]).orderBy("bucket").collect()] == [("(-inf, 5]", 1), ("(5, 6]", 0), ("(6, inf)", 1)]
    (a,) = clinical.adherence(rx, as_of).collect()
    assert (a.fills, a.gaps, a.gap_days, a.days_covered, a.label) == (2, 1, 12, 10 + 334, "adherent")


def test_upserts_and_links(spark):
    old = spark.createDataFrame([(1, "a", 10)], "id int, v string, created_at int")
    new = spark.createDataFrame([(1, "b", 20), (2, "c", 21), (2, "d", 22)], "id int, v string, created_at int")
    once = frames.upsert_nodes(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "b", 10), (2, "d", 21)]
    assert sorted(map(tuple, frames.upsert_nodes(once, new, ["id"]).collect())) == sorted(map(tuple, once.collect()))
    p = spark.createDataFrame([("slack:ann", "slack:ann"), ("github:ann", "Ann"), ("github:bob", "Bob")], "person_key string, display_name string")
    assert {tuple(r) for r in resolve.link_persons(p).collect()} == {("person:ann", "slack:ann", "Ann"), ("person:ann", "github:ann", "Ann")}
    rec = spark.createDataFrame([("x", "y", 1), ("z", "x", 2), ("q", "q", 5)], "a string, b string, weight int")
    assert {tuple(r) for r in recall.bump(rec.where("a < b"), rec).collect()} == {("x", "y", 2), ("x", "z", 2)}
    w = sinks.write_atoms(spark.createDataFrame([("i", "/a", "c", "note", "normal", "e1", None)], "instance string, cwd string, content string, kind string, salience string, episode string, supersedes string"), ts(AS_OF))
    assert w["atoms"].count() == w["jobs"].count() == w["in_episode"].count() == 1 and w["supersedes"].count() == 0


def test_resolver_zones_and_aliases(spark):
    ents = spark.createDataFrame([("1", "Anna Smith", "person"), ("2", "Brainbox", "project")], "id string, name string, type string")
    names = spark.createDataFrame([("m1", "Brainbox", "project"), ("m2", "Anna Smyth", "person"), ("m3", "Zed", "tool"), ("m4", "zed", "tool")], "mention string, name string, type string")
    pairs = names.crossJoin(ents.select(F.col("id").alias("entity"), F.col("name").alias("entity_name"), F.col("type").alias("entity_type"))).withColumn("last_seen", ts(AS_OF)).withColumn("overlap", F.lit(1.0)).withColumn("place", F.lit(1))
    got = {r.mention: r for r in resolve.resolve(names, ents, pairs, ts(AS_OF)).collect()}
    assert got["m1"].decision == "exact" and got["m2"].decision in ("accept", "suspect") and got["m3"].entity == got["m4"].entity
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    root = maintain.roots(c)
    assert {tuple(r) for r in root.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    e = spark.createDataFrame([("a", "A", 2, 5, ["z"], "active"), ("b", "B", 3, 9, None, "active"), ("c", "C", 1, 1, [], "active"), ("n", "N", 1, 1, [], "active")], "id string, name string, mention_count int, last_seen int, aliases array<string>, status string")
    out = {r.id: r for r in maintain.collapse_entities(e, root).collect()}
    assert (out["a"].mention_count, out["a"].last_seen, out["a"].aliases) == (6, 9, ["B", "C", "z"]) and out["b"].status == "merged"
    m = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 2), (3, "n", 1)], "atom int, entity string, prominence int")
    assert {tuple(r) for r in maintain.collapse_mentions(m, root).collect()} == {(1, "a", 3), (2, "a", 2), (3, "n", 1)}


def test_passes_registry_spec():
    out = maintain.run_passes(["a", "b", "c"], {"a": lambda **k: k["x"], "c": lambda **k: 1 / 0}, x=4)
    assert [(r["pass"], r["ok"]) for r in out] == [("a", True), ("b", False), ("c", False)] and out[0]["stats"] == 4
    with pytest.raises(ValueError):
        registry.FUNCTIONS["working_memory"](None, [], limit=99)
    assert set(registry.FUNCTIONS.bundle("research")) == {"get_trending", "get_landscape", "get_entity_network"}
    for bad in ({"occurrences": ["lower"]}, {"occurrences": ["IS_A"]}, {"accept": 0.4}, {"atom_kinds": []}):
        with pytest.raises(ValueError):
            spec.GraphSpec(**({"atom_kinds": ["note"], "entity_types": ["t"], "occurrences": ["M"], "associations": {"A": True}} | bad))


def test_portfolio_and_research(spark):
    pr = spark.createDataFrame([("a", "/w/a", "git@h:Org/a.git"), ("b", "/w/a/b", "https://h/org/b"), ("c", "/x", "https://h/other/c")], "project string, path string, remote string")
    assert {tuple(r) for r in portfolio.same_org(pr).select("a", "b").collect()} == {("a", "b")}
    s = spark.createDataFrame([(1, "/w/a/b/src"), (2, "/w"), (3, "/q")], "session int, dir string")
    assert {tuple(r) for r in portfolio.match_project(s, pr).collect()} == {(1, "b"), (2, "b")}
    man = spark.createDataFrame([("c", "file:/w/a/b/lib"), ("c", "^1.0")], "project string, version string")
    assert {tuple(r) for r in portfolio.local_references(man, pr).collect()} == {("c", "a"), ("c", "b")}
    rel = lambda k, c: spark.createDataFrame([("a", "b", k, c)], "a string, b string, kind string, confidence string")
    assert [r.confidence for r in portfolio.relations(rel("K", "high"), rel("K", "low")).collect()] == ["high"]
    schema = "batch int, activity_ids array<string>, entities array<struct<name: string, type: string>>, events array<struct<title: string, date: string, involved_entities array<struct<name: string, role: string>>>>, relationships array<struct<from_entity: string, to_entity: string, relation_type: string>>, trends array<struct<name: string, linked_events array<string>>>"
    b = spark.createDataFrame([(1, ["x", "y"], [("Open AI", "org"), ("B", "org")], [("Big Launch", "2024", [("Open AI", "lead"), ("Gone", "x")])], [("Open AI", "B", "rival"), ("B", "Gone", "z")], [("Agents", ["Big Launch", "No"])])], schema.replace("involved_entities array", "involved_entities: array").replace("linked_events array", "linked_events: array"))
    t = research.extraction_tables(b)
    assert {k: v.count() for k, v in t.items()} == {"entities": 2, "events": 1, "involved_in": 1, "related": 1, "trends": 1, "part_of_trend": 1, "entity_mentions": 4, "event_mentions": 2}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(0, 30), st.integers(0, 12))
def test_budget_prefix_is_longest(spark, lengths, budget, n):
    df = spark.createDataFrame([(1, i, "x" * k) for i, k in enumerate(lengths)], "g int, i int, t string")
    got = sorted(r.i for r in frames.within_budget(df, ["g"], ["i"], "t", budget, n).collect())
    want = []
    for i, k in enumerate(lengths):
        if sum(lengths[: i + 1]) > budget or i >= n:
            break
        want.append(i)
    assert got == want


def test_every_query_runs(spark):
    for name, q in catalogue.QUERIES.items():
        assert q(spark, "/root/testdata/sf0.001").columns, name


def test_passes_are_isolated_and_timed(spark):
    slow = lambda: spark.range(0, 40, 1, 40).select(F.expr("java_method('java.lang.Thread', 'sleep', 2000L)")).collect()
    out = maintain.run_passes(["slow", "no", "bad", "good"], {"slow": slow, "bad": lambda: 1 / 0, "good": lambda: 3}, timeout=1.0, spark=spark)
    assert [(x["pass"], x["ok"]) for x in out] == [("slow", False), ("no", False), ("bad", False), ("good", True)]
    assert "timed out" in out[0]["error"] and spark.range(5).count() == 5


def test_access_folding_is_the_fold(spark):
    import random

    r = random.Random(4)
    log = [(r.randrange(60), r.randrange(6), r.choice([0.1, 0.3, 0.4, 0.5, 0.9])) for _ in range(300)]
    atoms = [(i, ["cold", "warm", "hot"][i % 3]) for i in range(70)]
    want = {}
    for i, tier in atoms:
        level = ["cold", "warm", "hot"].index(tier)
        for _, w in sorted((ts, w) for a, ts, w in log if a == i):
            level = 1 if level == 0 and w >= 0.3 else 2 if level == 1 and w >= 0.5 else level
        want[i] = ["cold", "warm", "hot"][level]
    got = recall.fold_accesses(spark.createDataFrame(atoms, "atom int, tier string"), spark.createDataFrame(log, "atom int, ts int, weight double"))
    assert {x.atom: x.tier for x in got.collect()} == want
