import hashlib
import random
import re

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mnemo.llm import secrets as s


def corpus():
    r = random.Random(3)
    rows = []
    for i in range(300):
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(40))
        number = "".join(r.choice("0123456789") for _ in range(16))
        body = ["the sun fell", f'token = "{hexa}" rose', f"see {number} there", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) + " end"][i % 4]
        rows.append((i, f"over the hill {body} and on", f"src{i % 3}", len(body)))
    return rows


def test_forest_keeps_secrets_and_drops_numbers(spark):
    rows = corpus() + [(900, None, "x", 0), (901, "", "x", 0), (902, "word " * 50_000, "x", 1), (None, "password=abc123def456789ff", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = s.scan(docs).collect()
    text = {i: t for i, t, *_ in rows}
    assert all(hashlib.sha256(text[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.digest for r in out)
    assert {r.doc_id for r in out if r.secret} == {i for i in range(300) if i % 4 in (1, 3)} | {None}
    assert {r.doc_id for r in out if not r.secret} == {i for i in range(300) if i % 4 == 2}
    clean = {r.doc_id: r for r in s.redact(docs).collect()}
    assert len(clean) == len(rows)
    assert clean[1].text == 'over the hill token = "[secret]" rose and on' and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text == text[2] and clean[900].text is None and clean[None].text == "password=[secret]"


def test_little_or_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    assert s.scan(docs).count() == 0 and s.redact(docs).count() == 0
    one = spark.createDataFrame([(1, "id ab12cd34ef56 x", "a")], "doc_id long, text string, score string")
    assert s.scan(one).first().score == 0.5


def test_scores_against_a_plain_scan(spark):
    """Findings, labels and features made row by row outside Spark, and the same forest asked for each of them."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    known = s.dictionary(docs)
    assert set(known) == {w for _, text, *_ in rows for w in re.findall("[a-z]{3,12}", text.lower())}
    plain = []
    for i, text, source, _ in rows:
        own = [(a, b, name, told) for a, b, name, told in s.assigned_values(text)]
        own += [(m.start(), m.end(), None, False) for m in s.FINDING.finditer(text) if not any(a < m.end() and m.start() < b for a, b, *_ in own)]
        for a, b, name, told in own:
            left = s.BEFORE.search(text[: a if name is None else name])
            before, assigned = left[1], name is not None or bool(left[2])
            plain.append((i, a, b - a, s.rule_label(text[a:b], before, assigned, told), s.features(text[a:b], before, assigned, s.NEXT.search(text[b:])[1], source, set(known))))
    found = s.findings(docs, known)
    got = {(r.doc_id, r.start, r.length): (r.labelled, r.features) for r in found.collect()}
    assert got == {(i, a, n): (label, f) for i, a, n, label, f in plain}
    sure = found.where("labelled >= 0").select(F.col("labelled").alias("label"), "features", F.xxhash64("doc_id", "version", "start").alias("key"))
    forest = s.train(sure)
    out = {(r.doc_id, r.start): r for r in s.scan(docs).collect()}
    for i, a, _, _, f in plain[:40]:
        p = forest.predictProbability(Vectors.dense(f))[1]
        assert abs(out[i, a].score - p) < 1e-9 and out[i, a].secret == (p >= 0.5)
