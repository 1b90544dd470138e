import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from mnemo.operators import portfolio


def test_hot_package_relates_all_its_users(spark):
    r = random.Random(2)
    uses = {(p, "hot") for p in range(150)} | {(r.randrange(200), f"d{r.randrange(40)}") for _ in range(300)}
    users = {}
    for p, d in uses:
        users.setdefault(d, set()).add(p)
    shared, most = Counter(), {}
    for own in users.values():
        for k in combinations(sorted(own), 2):
            shared[k] += 1
            most[k] = max(most.get(k, 0), len(own))
    want = {(*k, n, most[k], "high" if most[k] >= 3 else "medium") for k, n in shared.items()}
    df = spark.createDataFrame(sorted(uses), "project int, dep string")
    assert {tuple(x) for x in portfolio.shared_packages(df).collect()} == want
    dealt = portfolio.shared_packages(df, block=7).collect()
    assert {tuple(x) for x in dealt} == want and len(dealt) == len(want)


def test_notable_by_name(spark):
    names = spark.createDataFrame([(n,) for n in ("@org/x", "aws-sdk", "http-client", "rapid", "react", "x@y")], "name string")
    assert {x.name for x in names.where(portfolio.notable_name(F.col("name"))).collect()} == {"@org/x", "aws-sdk", "http-client", "rapid"}
