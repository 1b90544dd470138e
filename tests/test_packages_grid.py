"""Pairs of a package's users are not shuffled."""

from mnemo.operators import portfolio
from tests.test_grid import brute_pairs


def shuffled(spark, work):
    """(result, rows that the work's stages put into shuffles and saved tables)."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in (found.apply(i) for i in range(found.size()))}

    before, out = stages(), work()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_shared_packages_shuffle_uses_not_pairs(spark):
    uses = [(p, d) for d in range(60) for p in range(80)]
    df = spark.createDataFrame(uses, "project long, dep long")
    out, rows = shuffled(spark, lambda: portfolio.shared_packages(df).collect())
    assert sorted(tuple(r)[:4] for r in out) == brute_pairs(uses)
    assert rows < 3 * len(uses)  # of 189,600 pairs
