import random


import pyarrow as pa

import corpus_pipeline as c
from mnemo.llm.common import saved
from mnemo.llm.tokens import encoder
from tests.llm.test_dedup import brute, sets_of


def world(spark, folder):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        t = text(r.choice([0, 4, 40, 80]))
        if i % 6 == 0:
            t = f"{text(10)}. {text(3)} vile {text(3)}. {t}"
        if i % 11 == 5:
            t = f"{t} {items[i % 5][1]} {text(5)}"
        if i % 10 == 7:
            t = f'{t} token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" {text(3)} {"".join(r.choice("0123456789") for _ in range(16))}'
        if i % 9 == 8:
            t = docs[i - 7][1]
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, 1, int("vile" in t)))
    docs += [(900, None, "en", None, None), (901, "", None, "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_every_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = world(spark, folder)
    want = {i: t for i, t, *_ in docs}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for name, stage in c.STAGES[:-1]:
        now = saved(stage(spark, now, folder), name)
        assert now.columns == columns
        got = {r.doc_id: r.text for r in now.collect()}
        assert now.count() == len(got)
        if name == "toxicity":
            want = {i: t for i, t in want.items() if "vile" not in (t or "")}
        elif name == "near_duplicates":
            kept = {i for i, _, top, keep in brute(list(want.items())) if keep}
            want = {i: t for i, t in want.items() if i in kept}
        elif name == "decontamination":
            want = {i: t for i, t in want.items() if not any(len(sets_of(t) & sets_of(u)) >= 0.75 * len(sets_of(u)) for _, u in items)}
        else:
            hidden = {i for i, t in want.items() if "token" in (t or "")}
            assert hidden and all(("[secret]" in (got[i] or "")) == (i in hidden) for i in want)
            assert all(got[i] == want[i] for i in want if i not in hidden)
            assert all(r.n_chars == len(r.text) for r in now.collect() if r.doc_id in hidden)
            want = {i: got[i] for i in want}
        assert got == want, name
    pieces = c.STAGES[-1][1](spark, now, folder).collect()
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in want} == {i: int(encoder().encode(pa.array([t], pa.string()))[1][0]) + 1 for i, t in want.items()}
    assert len(c.run(spark, folder).collect()) == len(pieces)
