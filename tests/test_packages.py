from mnemo.operators import portfolio


def test_hot_package_gives_members_not_pairs(spark):
    uses = spark.createDataFrame([(p, "hot") for p in range(5000)] + [(1, "x"), (2, "x"), (2, "y"), (3, "y"), (1, "y"), (9, "own"), (1, "x")], "project long, dep string")
    g = portfolio.package_groups(uses)
    assert sorted(tuple(r) for r in g["pairs"].collect()) == [(1, 2, 2, 3, "high"), (1, 3, 1, 3, "high"), (2, 3, 1, 3, "high")]
    members = g["members"].collect()
    assert len(members) == 5000 and {(r.dep, r["head"], r.users, r.confidence) for r in members} == {("hot", 0, 5000, "high")}
    few = portfolio.package_groups(uses, spark.createDataFrame([("x",)], "dep string"))
    assert few["pairs"].count() == 1 and few["members"].count() == 0


def test_counts_and_members(spark):
    uses = spark.createDataFrame([("a", "p", "1"), ("b", "p", "2"), ("b", "p", "2"), ("c", "q", ""), ("d", "q", "")], "project string, dep string, version string")
    assert sorted(tuple(r) for r in portfolio.dependency_counts(uses).collect()) == [("p", 2, 2, True), ("q", 2, 0, False)]
    assert sorted(tuple(r) for r in portfolio.dependency_members(uses).collect()) == [("p", "a", "1", "2", True), ("p", "b", "2", "2", False), ("q", "c", "", "", False), ("q", "d", "", "", False)]


def test_paths_meet_at_whole_names(spark):
    p = spark.createDataFrame([("one", "/w/1/"), ("ten", "/w/10"), ("deep", "/w/1/lib/x"), ("all", "/"), ("none", None)], "project string, path string")
    s = spark.createDataFrame([(1, "/w/1/src"), (2, "/w/10"), (3, "/w/1/lib"), (4, "/w"), (5, "/else"), (6, None), (7, "")], "session long, dir string")
    got = {r.session: r.project for r in portfolio.match_project(s, p).collect()}
    assert got == {1: "one", 2: "ten", 3: "deep", 4: "deep"}
    plan = portfolio.match_project(s, p)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_relative_and_absolute_references(spark):
    p = spark.createDataFrame([("one", "/w/1"), ("two", "/w/2"), ("in", "/w/2/sub")], "project string, path string")
    m = spark.createDataFrame([("one", "../2/sub/./pkg"), ("one", "file:../2"), ("two", "link:/w/1/x"), ("two", "./sub"), ("one", "^1.0"), ("in", "../../../../.."), ("one", "file:lib"), ("lost", "../1")], "project string, version string")
    got = {(r.project, r.target) for r in portfolio.local_references(m, p).collect()}
    assert got == {("one", "in"), ("one", "two"), ("two", "one"), ("two", "in")}
