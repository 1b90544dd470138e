import math
import random
import re

from mnemo.operators import search


def brute(docs, queries, k, digits=6):
    tok = {i: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w] for i, t in docs}
    avg, out = sum(map(len, tok.values())) / len(tok), []
    for q, text in queries:
        scores = {}
        for w in {w for w in re.split(r"[^a-z0-9]+", text.lower()) if w}:
            df = sum(w in t for t in tok.values())
            for i, t in tok.items():
                if w in t:
                    tf = t.count(w)
                    scores[i] = scores.get(i, 0) + round(math.log(1 + (len(tok) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg)), 9)
        out += [(q, i, round(s, digits)) for s, i in sorted((-round(s, digits), i) for i, s in scores.items())[:k] for s in [-s]]
    return sorted(out)


def rows_of(df):
    return sorted((r["query"], r["id"], r["score"]) for r in df.collect())


def near(a, b):
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b))


def texts(spark, docs):
    return spark.createDataFrame([("d", i, t) for i, t in docs], "label string, id long, text string")


def test_blocks_segments_and_replaced_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 20)
    monkeypatch.setattr(search, "FEW", 4)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randrange(1, 30))) for i in range(300)] + [(300, None), (301, "")]
    queries = [(q, text(4)) for q in range(25)] + [(99, "unknown")]
    q = spark.createDataFrame(queries, "query long, text string")
    index = search.Index.build(texts(spark, docs), str(tmp_path / "i"))
    assert sum(index.pinned["blocks"]) > 10
    near(rows_of(index.search(q, 5)), brute(docs, queries, 5))

    files = {f for fs in index.pinned["tables"]["postings"]["parts"].values() for f in fs}
    changed = {7: "w1 w2 w59", 8: "w3", 400: "w1 w1 w58"}
    docs2 = [(i, changed.get(i, t)) for i, t in docs] + [(400, changed[400])]
    old_reader = search.Index(spark, str(tmp_path / "i"))
    monkeypatch.setattr(search, "FEW", 3)
    index.update(texts(spark, docs2))
    assert index.update(texts(spark, docs2)) is None
    assert files < {f for fs in index.pinned["tables"]["postings"]["parts"].values() for f in fs}
    new = index.store.read("documents").where("segment = 2")
    assert sorted(r.id for r in new.collect()) == [7, 8, 400]
    near(rows_of(index.search(q, 5)), brute(docs2, queries, 5))
    near(rows_of(old_reader.search(q, 5)), brute(docs, queries, 5))


def test_only_buckets_of_query_terms_are_read(spark, tmp_path):
    docs = [(i, f"name{i} common") for i in range(200)]
    index = search.Index.build(texts(spark, docs), str(tmp_path / "i"))
    out = index.search(spark.createDataFrame([(1, "name5")], "query long, text string"), 3)
    assert [r.id for r in out.collect()] == [5]
    assert len({f.split("_bucket=")[1].split("/")[0] for f in out.inputFiles() if "_bucket=" in f}) == 1


def test_several_columns_of_a_document(spark):
    t = spark.createDataFrame([("d", 1, "a b"), ("d", 1, "b c"), ("e", 1, "b")], "label string, id long, text string")
    out = search.Index.build(t).search(spark.createDataFrame([(1, "b")], "query long, text string"), 3).collect()
    assert sorted((r.label, r.id) for r in out) == [("d", 1), ("e", 1)]


def test_terms_of_all_queries_are_scored_once_a_set(spark, monkeypatch):
    monkeypatch.setattr(search, "COMMON", 10)
    rng = random.Random(7)
    docs = [(i, rng.choice(["supplier", "supplier of", "supplier of supplier", "of"]) + f" n{rng.randrange(60)}") for i in range(80)]
    queries = sorted({(t, t) for _, t in docs} | {("supplier", "supplier"), ("n3", "n3")})
    index = search.Index.build(texts(spark, docs))
    made = []
    monkeypatch.setattr(search, "_by_sets", lambda *a, f=search._by_sets: made.append(1) or f(*a))
    got = index.search(spark.createDataFrame(queries, "query string, text string"), 3)
    near(rows_of(got), brute(docs, queries, 3))
    assert made  # before, each query met each document of its common terms


def test_one_search_equals_the_rule_and_saves_no_index(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK_DOCS", 30)
    monkeypatch.setattr(search, "CELLS", 200)
    monkeypatch.setattr(search.Index, "update", lambda *a: 1 / 0)  # before, the query wrote postings of all terms
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 25)))) for i in range(260)] + [(300, None), (301, ""), (302, "w0"), (303, "w0")]
    queries = [(q, " ".join(rng.choices(words, weights, k=5))) for q in range(30)] + [(98, "w0"), (99, "unknown")]
    q = spark.createDataFrame(queries, "query long, text string")
    near(rows_of(search.search_once(texts(spark, docs), q, 6)), brute(docs, queries, 6))
    two = texts(spark, docs).union(texts(spark, docs[:50]).replace("d", "e", ["label"])).union(texts(spark, [(7, "w39 w39")]))
    got = search.search_once(two, q, 300)
    whole = [(i, f"{t} w39 w39" if i == 7 else t) for i, t in docs]
    near(rows_of(got.where("label = 'd'")), brute(whole, queries, 300))
    near(rows_of(got.where("label = 'e'")), brute(docs[:50], queries, 300))
    assert search.search_once(texts(spark, []), q).collect() == []
    assert search.search_once(texts(spark, docs), q.limit(0)).collect() == []


def test_registered_search_makes_no_postings_of_terms_that_are_not_asked(spark, monkeypatch):
    from mnemo.plans import catalogue

    monkeypatch.setattr(search.Index, "build", lambda *a: 1 / 0)
    assert catalogue.QUERIES["bm25_search"](spark, "/root/testdata/sf0.001").count() > 0


def test_equal_texts_are_searched_once(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    names = [" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(25)]
    docs = [(i, rng.choice([*names, None, ""])) for i in rng.sample(range(2000), 600)] + [(3000, "w1 w1 w1 w1"), (3001, "only this")]
    queries = [(q, " ".join(rng.choices(words, k=2))) for q in range(20)] + [(98, "this"), (99, "unknown")]
    q, kept = spark.createDataFrame(queries, "query long, text string"), []
    monkeypatch.setattr(search, "saved", lambda df, tag, f=search.saved: kept.append((tag, f(df, tag))) or kept[-1][1])
    two = texts(spark, docs).union(texts(spark, docs[:70]).replace("d", "e", ["label"]))
    for k in (1, 4, 300):
        got = search.search_once(two, q, k, equal=True)
        near(rows_of(got.where("label = 'd'")), brute(docs, queries, k))
        near(rows_of(got.where("label = 'e'")), brute(docs[:70], queries, k))
        assert dict(kept)["postings"].where("term = '' and label = 'd'").count() == len({t or "" for _, t in docs})  # before: a row a document
    assert search.search_once(texts(spark, []), q, equal=True).collect() == []
