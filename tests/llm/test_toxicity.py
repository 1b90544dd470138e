import math
import random
import re
import zlib

from mnemo.llm import toxicity as t

BAD, GOOD = ["vile", "nasty"], ["sun", "rain", "tree", "bird", "stone", "cloud"]


def corpus():
    docs, labels, r = [], [], random.Random(2)
    for i in range(400):
        w = [f"The {r.choice(GOOD)} and {r.choice(GOOD)} met.", f"Some {r.choice(GOOD)} fell!"]
        if i % 4 == 0:
            w.insert(1, f"You {BAD[i % 8 // 4]} thing.")
        docs.append((i, " ".join(w), "x", i))
        labels.append((i, 0, int(i % 4 == 0)))
    return docs + [(1000, None, "x", 1), (1001, "", "x", 1), (1002, "sun. " * 20000, "x", 1), (None, "vile", "x", 2)], labels


def test_learns_and_locates(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, label int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = t.score(d, t.train(d, lab)).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    for i, text, *_ in docs[:400]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i].predicted == int(i % 4 == 0)
        if i % 4 == 0:
            (s,) = by[i].offending
            assert text[s.start : s.start + s.length].strip().startswith("You")
    assert not by[1000].predicted and not by[1001].predicted and not by[1002].predicted and by[None].predicted
    kept = t.reject_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == 303


def test_empty_tables(spark):
    d, lab = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert t.score(d, t.train(d, lab)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert t.score(one, t.train(one, lab)).first().predicted == 0


def test_scores_against_a_plain_noisy_or(spark):
    """Every document's score from the model's weights, by splitting and multiplying in plain Python."""
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, label int")
    model = t.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    weight = {w: float(model.weights[i]) for w, i in model.index.items()}
    assert weight

    def brute(text):
        clean = 1 - model.leak
        for sentence in re.split(r"[.!?\n]", text or ""):
            known = {w for w in re.findall(r"[^\W\d_]+", sentence.lower()) if w in weight}
            if known:
                clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weight[w] for w in known))))
        return 1 - clean

    texts = {i: text for i, text, *_ in docs}
    out = t.score(d, model).collect()
    assert len(out) == len(docs)
    assert all(abs(r.score - brute(texts[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.5) for r in out)
