"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A document is toxic with probability 1 - (1 - leak) * prod(1 - p(sentence)); p(sentence) is a logistic
score of the sentence's distinct indicative words, and 0 without any, so length alone convicts no
text. Words are
chosen and weights fitted on a bounded sample of the labelled rows (FIT_DOCS).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import saved

#: Labelled documents to learn from, at most.
FIT_DOCS = 20_000
#: Words kept, at most, and the least log-likelihood ratio and training documents of one.
VOCABULARY, LEAST_LLR, LEAST_DOCS = 2048, 24.0, 5
#: Fixed bias of a sentence with indicative words: a word must earn some weight to convict on its own.
BIAS = -1.0
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; such labels are never learned from. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        every, toxic = Counter(), Counter()
        for text, label in zip(f["text"], f["toxic"], strict=True):
            found = set(WORD.findall((text or "").lower()))
            every.update(found)
            if label:
                toxic.update(found)
        yield pd.DataFrame({"word": list(every), "n": list(every.values()), "n_toxic": [toxic[w] for w in every]})


def _bags(frames: Iterator[pd.DataFrame], index: dict[str, int]) -> Iterator[pd.DataFrame]:
    """The indicative words of each document's sentences that have any."""
    for f in frames:
        rows = []
        for text, label in zip(f["text"], f["toxic"], strict=True):
            rows.append((int(label), [ids for _, _, ids in sentences_of(text or "", index)]))
        yield pd.DataFrame(rows, columns=["toxic", "bag"])


def sentences_of(text: str, index: dict[str, int]) -> list[tuple[int, int, list[int]]]:
    """Place, length and indicative words of the sentences that have any."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: keep offsets by lowering one by one
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if index.keys().isdisjoint(WORD.findall(low)):
        return []
    bag = []
    for m in SENTENCE.finditer(low):
        ids = sorted({index[w] for w in WORD.findall(m[0]) if w in index})
        if ids:
            bag.append((m.start(), m.end() - m.start(), ids))
    return bag


class Model:
    """Word weights, the bias of a sentence and the leak of a document."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: float, leak: float):
        self.index, self.weights, self.bias, self.leak = index, weights, bias, leak

    def sentence(self, ids: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[ids].sum()))))

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The document's probability, and its sentences of 0.5 or more with place (in characters) and score."""
        clean, spans = 1 - self.leak, []
        for start, length, ids in sentences_of(text or "", self.index):
            p = self.sentence(ids)
            clean *= 1 - p
            if p >= 0.5:
                spans.append({"start": start, "length": length, "score": p})
        return float(min(1.0, max(0.0, 1 - clean))), spans


def fit(bags: pd.DataFrame, index: dict[str, int], rounds: int = 400, rate: float = 0.1, prior: float = 0.5) -> Model:
    """Full-batch Adam on the noisy-or likelihood of the document labels with a Gaussian prior of precision
    `prior` on the weights; deterministic. BIAS and prior were chosen on a fifth of the training rows."""
    n, y = len(bags), bags["toxic"].to_numpy(dtype=float)
    times = bags["n"].to_numpy(dtype=float)
    doc = np.repeat(np.arange(n), [len(b) for b in bags["bag"]])
    sizes = [len(s) for b in bags["bag"] for s in b]
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    word = np.array([i for b in bags["bag"] for s in b for i in s], dtype=np.int64)
    base = min(max(np.average(y, weights=times) if n else 0.01, 1e-3), 0.5)
    theta = np.concatenate([np.zeros(len(index)), [BIAS, np.log(base / (1 - base)) - 1]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        z = bias + np.bincount(sentence, weights=w[word], minlength=len(sizes))
        p = 1 / (1 + np.exp(-z))
        spill = 1 / (1 + np.exp(-leak))
        log_clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=n) - np.logaddexp(0, leak)
        clean = np.exp(log_clean)
        g = times * (y * clean / np.maximum(1 - clean, 1e-9) - (1 - y))  # d likelihood / d (-log clean)
        per = g[doc] * p
        grad = np.concatenate([np.bincount(word, weights=per[sentence], minlength=len(index)), [per.sum(), g.sum() * spill]]) / max(times.sum(), 1)
        grad[:-2] -= prior * w / max(times.sum(), 1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[-2] = BIAS
        theta[-1] = min(theta[-1], -1.0)
    return Model(index, theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents that are not held out, at most FIT_DOCS of them: those with the least
    hashes of their ids. The bound makes the sample's labels small enough to broadcast, so no text is
    shuffled but the sample's, whose equal texts count once. Without any labels every text scores the leak."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = saved(known.orderBy(F.xxhash64("_id"), "_id").limit(FIT_DOCS), "sample")
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("text").agg(F.max("toxic").alias("toxic")), "train")
    n, k = (rows.count(), rows.where("toxic > 0").count())
    n = max(n, 1)
    counts = rows.mapInPandas(_word_counts, "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("k")).where(F.col("n") >= LEAST_DOCS)
    share, inside, outside = F.lit(k / n), F.col("k") / F.col("n"), (F.lit(k) - F.col("k")) / F.greatest(F.lit(n) - F.col("n"), F.lit(1))

    def likelihood(hits: Column, of: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return hits * F.log(p) + (of - hits) * F.log(1 - p)

    llr = 2 * (likelihood(F.col("k"), F.col("n"), inside) + likelihood(F.lit(k) - F.col("k"), F.lit(n) - F.col("n"), outside) - likelihood(F.lit(k), F.lit(n), share))
    chosen = counts.withColumn("llr", llr).where((F.col("llr") >= LEAST_LLR) & (inside > share)).orderBy(F.desc("llr"), "word").limit(VOCABULARY)
    index = {r["word"]: i for i, r in enumerate(chosen.select("word").collect())}
    bags = rows.mapInPandas(lambda frames: _bags(frames, index), "toxic int, bag array<array<int>>")
    # a text without any indicative word only counts
    bags = bags.groupBy("toxic", "bag").agg(F.count("*").alias("n")).toPandas()
    return fit(bags.sort_values(["toxic", "n"], kind="stable"), index)


SCORED = "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start int, length int, score double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, offending sentences (place in characters, score).

    Whole texts are scored. Null and empty texts have no sentence and score the leak; repeated rows and
    null ids are scored like others; an empty table gives no rows; other columns are not read.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [model.score(t) for t in f["text"]]
            out = pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": [s for s, _ in found]})
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            out["offending"] = [s for _, s in found]
            yield out

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(rows, SCORED)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, in one pass over the texts. Null and
    empty texts score the leak and stay; repeated rows share their fate; an empty table stays empty."""
    model = train(docs, labels)

    def keep(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series([model.score(t)[0] < 0.5 for t in texts], dtype=bool)

    return docs.where(F.pandas_udf(keep, "boolean")("text"))
