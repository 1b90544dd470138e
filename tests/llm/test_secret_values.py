import random

from mnemo.llm import secrets as s

VALUES = {
    'password = "hunter2"': "hunter2",
    'password = "correcthorsebattery"': "correcthorsebattery",
    "api_key=AbCdEfGhIjKlMnOpQrStUvWxYz": "AbCdEfGhIjKlMnOpQrStUvWxYz",
    'password = "Tr0ub4dor&3xyz"': "Tr0ub4dor&3xyz",
    'password="a b\\"c d", x': 'a b\\"c d',
    'password: str = "hu nter2"': "hu nter2",
    'my_secret_token: "é日本 語"': "é日本 語",
    "see ?token=abcdefg&user=bob": "abcdefg",
    "passwd => 'pq rs tu'": "pq rs tu",
    'password = "line1\nline2" z': "line1\nline2",
}


def test_every_assigned_value_is_one_candidate():
    for text, value in VALUES.items():
        assert [text[a:b] for a, b, *_ in s.assigned_values(text)] == [value], text
    for text in ("", "password", "password = ", 'password = ""', "token: \n"):
        assert s.assigned_values(text) == []
    text = "secret: token: abc. password=token=xyz"
    assert [text[a:b] for a, b, *_ in s.assigned_values(text)] == ["token:", "abc", "token=xyz"]


def test_short_and_digit_free_secrets_go(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, f'over {word(14)} and {word(16).upper()}/{word(6)} token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" see {r.randrange(10**15, 10**16)}') for i in range(200)]
    rows += [(1000 + i, f"over the hill {text} end") for i, text in enumerate(VALUES)]
    rows += [(2000, "the token AbCdEfGhIjKlMnOpQrStUvWxYzAbCdEfGhIjKlMn rose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {d.doc_id: d.text for d in s.redact(docs).collect()}
    for i, (text, value) in enumerate(VALUES.items()):
        assert clean[1000 + i] == f"over the hill {text.replace(value, '[secret]')} end"
    for i, text in rows[:200]:
        assert clean[i] == text[: text.index('"') + 1] + "[secret]" + text[text.rindex('"') :]
    assert {d.doc_id for d in s.scan(docs).where("doc_id = 2000").collect()} == {2000}


def test_a_rare_label_is_learned_whole(spark, monkeypatch):
    monkeypatch.setattr(s, "FIT_FINDINGS", 40)
    flat = [0.0] * 3
    rows = [(0, flat) for _ in range(3000)] + [(1, [1.0, float(i), 1.0]) for i in range(5)]
    labelled = spark.createDataFrame(rows, "label int, features array<double>")
    fitted = []
    fit = s.RandomForestClassifier.fit
    monkeypatch.setattr(s.RandomForestClassifier, "fit", lambda self, df: fitted.append({r["label"]: r["count"] for r in df.groupBy("label").count().collect()}) or fit(self, df))
    assert s.train(labelled).numClasses == 2
    assert fitted == [{0.0: 20, 1.0: 5}]
