"""Column builders for text, names, times and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 2000


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def snippet(c: Column, n: int = SNIPPET) -> Column:
    """The first n characters with an ellipsis where something is cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def hashtags(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?:^|\s)#(\w{2,})"), F.lit(1)), F.lower))


def user_mentions(c: Column) -> Column:
    """Chat form <@ID>."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"<@([A-Z0-9]+)>"), F.lit(1)))


def login_mentions(c: Column, longest: int = 39) -> Column:
    """@login, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(rf"@([A-Za-z0-9_\-]{{1,{longest}}})"), F.lit(1)), F.lower))


def handle_mentions(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"@(\w{1,15})"), F.lit(1)), F.lower))


def urls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"https?://[^\s>|]+"), F.lit(0)))


def allowed_topics(c: Column, allow: list[str]) -> Column:
    """Topics of an allow-list that occur as whole words, whatever their case."""
    found = [F.when(c.rlike(r"(?i)(?<![A-Za-z0-9_])\Q" + t + r"\E(?![A-Za-z0-9_])"), F.lit(t.lower())) for t in allow]
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\-]", ""), r"-{2,}", "-")
    return F.regexp_replace(s, r"^-+|-+$", "")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\\x1B\\[[0-9;?]*[ -/]*[@-~]", "")


def epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c.try_cast("long"))


def epoch_seconds(c: Column) -> Column:
    """A string of seconds with a fraction, as chats write it."""
    return F.timestamp_micros(F.round(c.try_cast("decimal(20,6)") * 1_000_000).cast("long"))


def ical_time(c: Column) -> Column:
    """DATE or DATE-TIME of a calendar, UTC where it ends in Z; null if it is neither."""
    at = lambda p: F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit(p))
    return F.when(c.rlike(r"^\d{8}T\d{6}Z?$"), at("yyyyMMdd'T'HHmmss")).when(c.rlike(r"^\d{8}$"), at("yyyyMMdd"))


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def terms(c: Column) -> Column:
    """All lower-case runs of letters and digits, with repeats."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bigrams(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(F.length(s) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def name_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), 0.7 * jaccard(tokens(a), tokens(b)) + 0.3 * jaccard(bigrams(a), bigrams(b))), F.lit(0.0))


def days_between(as_of: Column, ts: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000)


def linear_recency(as_of: Column, ts: Column, horizon: float = 365.0) -> Column:
    near = 1 - days_between(as_of, ts) / horizon  # greatest and least pass over nulls
    return F.when(near.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), near))).otherwise(0.0)


def recall_recency(as_of: Column, ts: Column, horizon: float = 90.0, floor: float = 0.1, unknown: float = 0.5) -> Column:
    near = 1 - days_between(as_of, ts) / horizon
    return F.when(near.isNotNull(), F.greatest(F.lit(floor), near)).otherwise(unknown)


def type_match(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def weighted_mean(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    return sum((F.coalesce(parts[k], F.lit(0.0)) * w for k, w in weights.items() if w), F.lit(0.0)) / total


def salience_weight(c: Column) -> Column:
    return F.when(c == "high", 1.25).when(c == "low", 0.6).otherwise(1.0)


def tier_weight(c: Column) -> Column:
    return F.when(c == "warm", 0.7).when(c == "cold", 0.4).otherwise(1.0)


def saturation(weight: Column, half: float = 3.0) -> Column:
    """w / (w + half): half strength at `half`."""
    return weight / (weight + half)


def access_saturation(count: Column) -> Column:
    return 1 / (1 + 0.01 * count)


def age_years(birth: Column, at: Column) -> Column:
    """Completed calendar years."""
    return F.year(at) - F.year(birth) - F.when(F.date_format(at, "MMdd") < F.date_format(birth, "MMdd"), 1).otherwise(0)


def fractional_age(birth: Column, at: Column) -> Column:
    return F.datediff(at, birth) / 365.25


def leading_number(c: Column) -> Column:
    """The number a text starts with, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def health_score(days: Column, commits: Column, stale: Column, dependencies: Column, sessions: Column, branches: Column) -> Column:
    """0 to 110 points for recency, activity, dependencies, sessions and branches."""
    recency = F.when(days <= 7, 40).when(days <= 14, 32).when(days <= 30, 24).when(days <= 60, 16).when(days <= 90, 8).otherwise(0)
    recency += F.when(commits >= 20, 10).when(commits >= 10, 7).when(commits >= 5, 4).when(commits >= 1, 2).otherwise(0)
    ratio = stale / F.nullif(dependencies, F.lit(0))
    fresh = F.when(dependencies == 0, 15).when(ratio == 0, 30).when(ratio < 0.1, 24).when(ratio < 0.25, 18).when(ratio < 0.5, 10).otherwise(4)
    used = F.when(sessions >= 5, 20).when(sessions >= 2, 14).when(sessions >= 1, 8).otherwise(0)
    tidy = F.when(branches <= 3, 10).when(branches <= 8, 6).when(branches <= 15, 3).otherwise(0)
    return recency + fresh + used + tidy


def health_label(score: Column, days: Column, commits: Column) -> Column:
    return F.when(days.isNull() & (commits == 0), "unknown").when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 35, "fair").otherwise("poor")


def json_candidate(c: Column) -> Column:
    """JSON in a model's answer: the whole text, a fenced block, or the outermost object or array."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    embedded = F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1)
    clean = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    valid = lambda x: F.when(clean(x).rlike(r"^[\[{]") & F.try_parse_json(clean(x)).isNotNull(), clean(x))
    return F.coalesce(valid(c), valid(fenced), valid(embedded))


def topics_line(c: Column) -> Column:
    line = F.regexp_extract(c, r"(?im)^\s*Topics:\s*(.+)$", 1)
    return F.array_distinct(F.filter(F.transform(F.split(line, ","), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def content_id(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def is_ulid(c: Column) -> Column:
    return c.rlike("^[0-9A-HJKMNP-TV-Z]{26}$")


#: The digits of ids.
ULID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ts: Column, seed: Column) -> Column:
    """An id of 26 digits: 48 bits of the time in milliseconds, then 80 bits of the seed's hash, so ids sort by time
    and a retried task makes the same ones."""
    digit = lambda n, shift: F.substring(F.lit(ULID_DIGITS), (F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    bits = lambda at: F.conv(F.substring(F.sha2(seed, 256), at, 10), 16, 10).cast("long")
    ms = F.unix_millis(ts.cast("timestamp"))
    return F.concat(*[digit(ms, 5 * i) for i in range(9, -1, -1)], *[digit(bits(at), 5 * i) for at in (1, 11) for i in range(7, -1, -1)])


def round2(c: Column) -> Column:
    return F.round(c, 2)


def last_part(c: Column) -> Column:
    return F.try_element_at(F.filter(F.split(c, "-"), lambda x: x != ""), F.lit(-1))


def direction(delta: Column, eps: float = 1e-9) -> Column:
    return F.when(delta > eps, "rising").when(delta < -eps, "falling").when(delta.isNotNull(), "stable")


def fact_sentence(name: Column, activities: Column, related: Column) -> Column:
    """`name: n activities; related: a, b`."""
    return F.concat_ws("", name, F.lit(": "), activities.cast("string"), F.lit(" activities"), F.when(F.size(related) > 0, F.concat(F.lit("; related: "), F.array_join(related, ", "))))


def strip_source(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^:]+:", "")


def dot(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; 0 where lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def keyword_hit(c: Column, keywords: list[str]) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k))


def is_code(c: Column) -> Column:
    return c.rlike(r"^\d{5,20}$")
