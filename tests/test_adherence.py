"""Refills that are alike but for their end, in any order of the input."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from mnemo.operators import clinical


def test_ties_of_lines_do_not_leave_gaps_to_chance(spark):
    day = dt.date(2000, 1, 1)
    same = [(1, "d", day, day + dt.timedelta(n) if n else None, 5, 1) for n in (3, 20, None)]
    later = (1, "d", dt.date(2000, 3, 1), dt.date(2000, 3, 2), 6, 1)
    schema = "patient long, drug string, start date, stop date, encounter long, line int"
    for some in (same[:2], same):
        seen = set()
        for rows in itertools.permutations(some):
            out = clinical.adherence(spark.createDataFrame([*rows, later], schema).coalesce(1), F.lit("2001-01-01").cast("date"))
            seen.add(tuple(out.select("gaps", "gap_days").head()))
        assert seen == {(1, 40) if len(some) == 2 else (0, 0)}  # the longest is followed by the next start
