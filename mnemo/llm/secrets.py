"""Secret scans: findings by pattern, false positives removed by a random forest.

Findings are all values assigned to a secret's name, whatever their length and characters, and all other
runs of twelve token characters or more. A quoted value ends at its closing quote before the next blank
line; an unquoted one starts on the line of its name and ends at white space or the next `name=`, without
closing punctuation. The forest sees their length, character transitions, dictionary coverage, path and
neighbouring words, and is trained from labelled findings; without labels of its own a corpus labels the
findings that fixed rules are sure of.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import saved, unused

#: Labelled findings used to fit the forest, half of them of each label at most (all of a rarer label); words
#: of the dictionary; trees and their depth.
FIT_FINDINGS, DICTIONARY, TREES, DEPTH = 50_000, 4000, 40, 8
FINDING = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{12,}(?:={1,2}(?![^\s\"'`,;)\]}<]))?")
BEFORE = re.compile(r"([\w.\-]*)[\"']?\s*([=:]?)\s*[\"']?$")
NEXT = re.compile(r"^[\"']?\s*([\w.\-]*)")
#: Hashed places of the words before and after, and of the path.
WORDS, PATHS = 16, 8

# Names that values are assigned to, and the shape of a provider's key id.
NAMES = re.compile(r"(?i)pass(word|wd)?|secret|token|api_?key|credential")
ASSIGNED = re.compile(
    f"(?i)(?:{NAMES.pattern[4:]})" + r"""[\w.\-]*+(?P<name>)[\"'`\]\\]*\s*(?P<by>:[ \t]*[\w.\[\]|]+[ \t]+=|[=:]+>?)"""
    r"""(?:\s*[bru]{0,2}(?P<q>\"{3}|'{3}|\\?[\"'`])(?P<quoted>(?:(?!(?P=q))(?:\\.|[^\\\n]|\n(?![ \t]*\n)))*)(?P=q)"""
    r"""|[ \t]*(?P<plain>(?:(?![&,;][\w.\-\"']+[=:])\S)+))"""
)
#: Words of one case, joined as in names and paths; no word of a language is much longer.
PROSE = re.compile(r"[-_/+]*(?:(?:[A-Z]?[a-z]{1,19}|[A-Z]{1,20})(?:[-_/+]+|$))+")
PROVIDER = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}")

FOUND = "doc_id long, version long, start int, length int, digest string, kind string, labelled int, features array<double>"


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The words of three letters or more in most documents; ties by word."""
    w = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,12}"), F.lit(0)))).alias("w"))
    return [r["w"] for r in w.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(value: str, known: set[str]) -> float:
    """Share of characters inside dictionary words, longest first from the left."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(12, 2, -1) if low[at : at + n] in known), 0)
        hit += n
        at += n or 1
    return hit / max(1, len(low))


def features(value: str, before: str, assigned: bool, after: str, path: str, known: set[str]) -> list[float]:
    kinds = [_kind(c) for c in value]
    counts = [kinds.count(k) / len(kinds) for k in range(4)]
    entropy = -sum(p * math.log2(p) for p in (value.count(c) / len(value) for c in set(value)))
    turns = [0.0] * 16
    for a, b in pairwise(kinds):
        turns[4 * a + b] += 1 / (len(kinds) - 1)
    near, tail, at = [0.0] * WORDS, [0.0] * WORDS, [0.0] * PATHS
    near[zlib.crc32(before.lower().encode()) % WORDS] = 1.0
    tail[zlib.crc32(after.lower().encode()) % WORDS] = 1.0
    at[zlib.crc32(path.encode()) % PATHS] = 1.0
    words = [float(assigned), float(bool(NAMES.search(before))), coverage(before, known)]
    return [float(len(value)), entropy, *counts, *turns, coverage(value, known), *words, *near, *tail, *at]


def rule_label(value: str, before: str, assigned: bool, told: bool = False) -> int:
    """1 or 0 where fixed rules are sure, else -1: a provider's shape or a value assigned to a secret's
    name is a secret; a plain number, a value of few different characters or words that are not assigned
    are none. told: the value stands unquoted after a colon, where words may as well be prose."""
    named = assigned and bool(NAMES.search(before))
    words = bool(PROSE.fullmatch(value))
    if PROVIDER.fullmatch(value) or (named and len(set(value)) > 6 and not (told and words)):
        return 1
    if value.strip("+-=/_").isdigit() or len(set(value)) <= 4 or (words and not assigned):
        return 0
    return -1


def assigned_values(text: str) -> list[list]:
    """[start, end, end of the name, unquoted after a colon] of non-blank values assigned to a NAMES word,
    in order and apart from each other. A value may hold an assignment itself, so the search goes on at its start."""
    out, at = [], 0
    while m := ASSIGNED.search(text, at):
        start, end = m.span("plain" if m["plain"] is not None else "quoted")
        at = max(start, m.start() + 1)
        if m["plain"] is not None:
            v = m["plain"].lstrip("\"'`\\([{<")
            start, end = end - len(v), end - len(v) + len(v.rstrip("\"'`\\)]}>,;."))
        if not text[start:end].strip():
            continue
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, m.start("name"), m["plain"] is not None and m["by"] == ":"])
    return out


def findings(docs: DataFrame, known: list[str]) -> DataFrame:
    """Every finding of whole texts with its place in characters, digest, rule label and features."""
    known = set(known)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, version, text, path in zip(f["doc_id"].array, f["version"], f["text"], f["path"], strict=True):
                own = assigned_values(text or "")
                ends = [end for _, end, _, _ in own]
                for m in FINDING.finditer(text or ""):
                    k = bisect_right(ends, m.start())
                    if k == len(own) or own[k][0] >= m.end():  # else it is a part of an assigned value
                        own.append([m.start(), m.end(), None, False])
                for at, end, name, told in own:
                    value = text[at:end]
                    b = BEFORE.search(text, max(0, (name or at) - 60), name or at)
                    before, assigned = (b[1], name is not None or bool(b[2])) if b else ("", False)
                    after = NEXT.search(text[end : end + 40])[1]
                    kind = "provider" if PROVIDER.fullmatch(value) else "assigned" if assigned else "bare"
                    digest = hashlib.sha256(value.encode(errors="surrogatepass")).hexdigest()
                    out.append((i, version, at, len(value), digest, kind, rule_label(value, before, assigned, told), features(value, before, assigned, after, path, known)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text", path.alias("path")).mapInPandas(rows, FOUND)


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """A forest from rows (label 0 or 1, features and, to tell equal rows apart, key); None if the rows to
    learn from do not hold both labels. Each label is sampled by itself, by a hash of the row."""
    most = FIT_FINDINGS // 2
    seen = {r["label"]: r["count"] for r in labelled.where("label in (0, 1)").groupBy(F.col("label").cast("int").alias("label")).count().collect()}
    if len(seen) < 2:
        return None
    key = F.col("key") if "key" in labelled.columns else F.monotonically_increasing_id()
    keyed = labelled.select(F.col("label").cast("double").alias("label"), "features", F.xxhash64("features", key).alias("_k"))
    parts = []
    for label, n in sorted(seen.items()):
        part = keyed.where(F.col("label") == label)
        if n > most:  # a fifth more than the bound, so that the cut below has enough rows
            part = part.where(F.pmod("_k", F.lit(1_000_000)) < int(1_200_000 * most / n)).orderBy(F.pmod("_k", F.lit(999_983)), "_k").limit(most)
        parts.append(part)
    rows = saved(parts[0].union(parts[1]).select("label", array_to_vector("features").alias("vector"), "_k").orderBy("_k").limit(2 * most), "fit")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7)
    return forest.fit(rows.select("label", "vector"))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row a finding: doc_id, version, start, length, digest, kind, score, secret.

    labelled: rows (label, features); by default the findings that the rules are sure of. score is the
    forest's probability and secret is score >= 0.5; where there are not both labels to learn from, the
    rule decides and an unsure finding scores 0.5. Null and empty texts have no findings; repeated rows
    have repeated findings; `version` tells texts of one id apart; empty tables give no rows. The
    secrets themselves are not returned.
    """
    known = dictionary(docs)
    found = saved(findings(docs, known), "findings")  # the fit reads it several times
    sure = labelled if labelled is not None else found.where("labelled >= 0").select(F.col("labelled").alias("label"), "features", F.xxhash64("doc_id", "version", "start").alias("key"))
    model = train(sure)
    keep = ["doc_id", "version", "start", "length", "digest", "kind"]
    if model is None:
        score = F.when(F.col("labelled") >= 0, F.col("labelled").cast("double")).otherwise(F.lit(0.5))
        out = found.select(*keep, score.alias("score"))
    else:
        out = model.transform(found.withColumn("vector", array_to_vector("features"))).select(*keep, F.get(vector_to_array("probability"), 1).alias("score"))
    return out.withColumn("secret", F.col("score") >= 0.5)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced by a mark and, if there is one, n_chars set anew; texts
    without secrets (null and empty ones too) stay as they are and all columns and rows are kept, repeated
    rows as often as they occur; an empty table stays empty."""
    i, version, found = (unused(docs, c) for c in ("_id", "_version", "_spans"))
    spans = scan(docs).where("secret").groupBy(F.col("doc_id").alias(i), F.col("version").alias(version)).agg(F.sort_array(F.collect_set(F.struct("start", "length")), asc=False).alias(found))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(version)), "left")
    cut = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(mark), F.substring(t, s["start"] + s["length"] + 1, F.length(t)))
    text = F.when(F.col(found).isNull(), docs["text"]).otherwise(F.aggregate(F.col(found), docs["text"], cut))
    out = {c: docs[c] for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col(found).isNull(), docs["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[c.alias(k) for k, c in out.items()])
