"""Clinical cohort operators: every one answers for all patients or for a key table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions.text import age_years, direction, fractional_age, round2
from mnemo.operators.frames import between, only, top


def medications(prescriptions: DataFrame, patients: DataFrame | None = None, active: bool | None = None, contains: str | None = None) -> DataFrame:
    out = only(prescriptions, patients, "patient")
    out = out if active is None else out.where(F.col("stop").isNull() if active else F.col("stop").isNotNull())
    return out if contains is None else out.where(F.contains("drug", F.lit(contains)))


def diagnoses(found: DataFrame, patients: DataFrame | None = None, status: str = "all", findings: bool = False, allow: list[str] = ()) -> DataFrame:
    """Conditions, active (no end), resolved or all; those that end in `(finding)` only if asked or allowed."""
    out = only(found, patients, "patient")
    out = {"active": out.where("stop is null"), "resolved": out.where("stop is not null"), "all": out}[status]
    return out if findings else out.where(~F.endswith("condition", F.lit("(finding)")) | F.col("condition").isin(list(allow)))


def labs(found: DataFrame, patients: DataFrame | None = None, codes: list | None = None, start=None, end=None) -> DataFrame:
    out = between(only(found, patients, "patient"), "date", start, end)
    return out if codes is None else out.where(F.col("code").isin(codes))


def procedures(found: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    return only(found, patients, "patient")


def temporal_relation(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tables (patient, date) of two kinds of events to (patient, first, second, relation)."""
    a, b = first.groupBy("patient").agg(F.min("date").alias("first")), second.groupBy("patient").agg(F.min("date").alias("second"))
    rel = F.when(F.col("first") < F.col("second"), "before").when(F.col("first") > F.col("second"), "after").otherwise("same_day")
    return a.join(b, "patient").select("patient", "first", "second", rel.alias("relation"))


def cohort(patients: DataFrame, found: DataFrame, prescriptions: DataFrame, conditions: list = (), drugs: list = (), gender: str | None = None, ages: tuple | None = None, as_of: Column | None = None) -> DataFrame:
    """Patients with all conditions (names containing a text, whatever its case) and all drugs, of a gender
    and an inclusive age in years of 365.25 days: one semi-join a criterion, so nothing multiplies."""
    out = patients if gender is None else patients.where(F.col("gender") == gender)
    if ages is not None:
        age = fractional_age(F.col("birth"), as_of)
        out = out.where((age >= ages[0]) & (age <= ages[1]))
    for c in conditions:
        out = out.join(found.where(F.contains(F.lower("condition"), F.lit(c.lower()))).select("patient"), "patient", "left_semi")
    for d in drugs:
        out = out.join(prescriptions.where(F.contains(F.lower("drug"), F.lit(d.lower()))).select("patient"), "patient", "left_semi")
    return out


def count_cohort(members: DataFrame) -> DataFrame:
    return members.agg(F.count("*").alias("n"))


def latest_values(found: DataFrame) -> DataFrame:
    """The last value of each patient and code; ties by id."""
    return found.where("value is not null").groupBy("patient", "code").agg(F.max_by("value", F.struct("date", "id")).alias("value"))


def aggregate_observation(found: DataFrame, members: DataFrame) -> DataFrame:
    """Six aggregates of the cohort's last values of each code. Sums are decimal, so order does not show."""
    v = latest_values(found.join(members, "patient", "left_semi")).withColumn("d", F.col("value").cast("decimal(18,4)"))
    total, n = F.sum("d"), F.count("*")
    return v.groupBy("code").agg(round2(total.cast("double") / n).alias("avg"), round2(F.min("value")).alias("min"), round2(F.max("value")).alias("max"), round2(total.cast("double")).alias("sum"), n.alias("n"), round2(F.median("value")).alias("median"))


def distribution(found: DataFrame, members: DataFrame, bounds: list[float]) -> DataFrame:
    """Patients a code and bucket (a, b] of their last values; empty buckets appear."""
    v = latest_values(found.join(members, "patient", "left_semi"))
    cuts = F.array(*[F.lit(float(b)) for b in bounds])
    count = v.select("code", F.size(F.filter(cuts, lambda b: F.col("value") > b)).alias("bucket")).groupBy("code", "bucket").agg(F.count("*").alias("n"))
    labels = [f"(-inf, {bounds[0]:g}]", *[f"({a:g}, {b:g}]" for a, b in zip(bounds, bounds[1:], strict=False)], f"({bounds[-1]:g}, inf)"]
    dense = v.select("code").distinct().select("code", F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("bucket", "label"))
    return dense.join(count, ["code", "bucket"], "left").select("code", "bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))


def equal_width(found: DataFrame, members: DataFrame, k: int = 5) -> list[float]:
    """The k - 1 inner bounds between the least and the greatest last value."""
    r = latest_values(found.join(members, "patient", "left_semi")).agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    return [] if r["a"] is None else [r["a"] + (r["b"] - r["a"]) * i / k for i in range(1, k)]


def ages(patients: DataFrame, as_of: Column, death: str | None = None) -> DataFrame:
    """Completed years at as_of or at death, and whether deceased."""
    at = F.least(as_of, F.coalesce(F.col(death), as_of)) if death else as_of
    return patients.select("patient", age_years(F.col("birth"), at).alias("age"), (F.col(death).isNotNull() if death else F.lit(False)).alias("deceased"))


def compare(found: DataFrame, a: Column | None = None, b: Column | None = None) -> DataFrame:
    """(patient, code, first, last, delta, direction, days): the values nearest to two dates, by default the
    first and the last; one value alone compares with itself."""
    pick = lambda d: F.min_by(F.struct("date", "value"), F.struct(F.abs(F.datediff("date", d)), "date", "id"))
    one = pick(a) if a is not None else F.min_by(F.struct("date", "value"), F.struct("date", "id"))
    two = pick(b) if b is not None else F.max_by(F.struct("date", "value"), F.struct("date", "id"))
    g = found.where("value is not null").groupBy("patient", "code").agg(one.alias("x"), two.alias("y"))
    delta = F.round(F.col("y.value") - F.col("x.value"), 6)
    return g.select("patient", "code", F.col("x.value").alias("first"), F.col("y.value").alias("last"), delta.alias("delta"), direction(delta).alias("direction"), F.datediff("y.date", "x.date").alias("days"))


def adherence(prescriptions: DataFrame, as_of: Column) -> DataFrame:
    """(patient, drug, fills, gaps, gap_days, days_covered, span_days, ratio, label) of refill intervals.

    A gap is counted where an interval ended before the next start; an open interval covers up to as_of. Of lines
    that are alike but for their end, the one that ends first comes first, an open one last.
    """
    w = Window.partitionBy("patient", "drug").orderBy("start", "encounter", "line", F.asc_nulls_last("stop"))
    x = prescriptions.withColumn("next", F.lead("start").over(w))
    gap = F.when(F.col("stop").isNotNull() & (F.col("next") > F.col("stop")), F.datediff("next", "stop")).otherwise(0)
    covered = F.greatest(F.lit(0), F.datediff(F.coalesce("stop", as_of), "start"))
    g = x.groupBy("patient", "drug").agg(F.count("*").alias("fills"), F.sum(F.when(gap > 0, 1).otherwise(0)).alias("gaps"), F.sum(gap).alias("gap_days"), F.sum(covered).alias("days_covered"), F.datediff(F.max(F.coalesce("stop", as_of)), F.min("start")).alias("span_days"))
    ratio = F.round(F.when(F.col("span_days") > 0, F.least(F.lit(1.0), F.col("days_covered") / F.col("span_days"))).otherwise(1.0), 6)
    return g.withColumn("ratio", ratio).withColumn("label", F.when(F.col("ratio") >= 0.8, "adherent").when(F.col("ratio") >= 0.5, "partial").otherwise("poor"))


def encounter_detail(encounters: DataFrame, wanted: DataFrame, sections: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Wanted encounters with each section's distinct texts, sorted and joined: one small aggregate a section."""
    out = encounters.join(wanted, "encounter", "left_semi")
    for name, (df, text) in sections.items():
        part = df.join(wanted, "encounter", "left_semi").groupBy("encounter").agg(F.array_join(F.array_sort(F.collect_set(text)), ",").alias(name))
        out = out.join(part, "encounter", "left")
    return out


def patient_summary(patients: DataFrame, sections: dict[str, tuple[DataFrame, Column]], n: int = 10) -> DataFrame:
    """Patients with counts and the first n sorted texts of each section."""
    out = patients
    for name, (df, text) in sections.items():
        part = df.groupBy("patient").agg(F.count("*").alias(f"n_{name}"), F.array_join(F.slice(F.array_sort(F.collect_set(text)), 1, n), ",").alias(name))
        out = out.join(part, "patient", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def treatments(prescriptions: DataFrame, contains: str | None = None, n: int = 20) -> DataFrame:
    """(condition, drug, patients, prescriptions): drugs given for a reason, by distinct patients."""
    p = prescriptions if contains is None else prescriptions.where(F.contains(F.lower("reason"), F.lit(contains.lower())))
    g = p.groupBy(F.col("reason").alias("condition"), "drug").agg(F.count_distinct("patient").alias("patients"), F.count("*").alias("prescriptions"))
    return top(g, ["condition"], [F.desc("patients"), "drug"], n)


def rank_conditions(found: DataFrame, members: DataFrame, n: int = 10) -> DataFrame:
    return found.join(members, "patient", "left_semi").groupBy("condition").agg(F.count_distinct("patient").alias("patients")).orderBy(F.desc("patients"), "condition").limit(n)
