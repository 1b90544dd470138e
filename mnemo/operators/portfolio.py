"""Project portfolios: health, activity, impact, dependencies, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions.text import health_label, health_score
from mnemo.operators import graph, grid
from mnemo.operators.frames import saved, top

cross_project_impact = graph.impact


def dependency_graph(uses: DataFrame) -> DataFrame:
    """(dep, users, projects, versions, mismatch): who uses a package in which version, as one text a package. For
    packages of very many users take dependency_counts and dependency_members."""
    one = F.concat_ws("@", "project", "version")
    return uses.groupBy("dep").agg(F.count_distinct("project").alias("users"), F.array_join(F.array_sort(F.collect_set(one)), ",").alias("projects"), F.count_distinct(F.nullif("version", F.lit(""))).alias("versions")).withColumn("mismatch", F.col("versions") > 1)


def dependency_counts(uses: DataFrame) -> DataFrame:
    """(dep, users, versions, mismatch) of each package: counts only, combined before the shuffle."""
    by = uses.groupBy("dep", "project", "version").agg(F.lit(1).alias("one"))
    users = by.groupBy("dep", "project").agg(F.lit(1).alias("one")).groupBy("dep").agg(F.count("*").alias("users"))
    versions = by.where("version <> ''").groupBy("dep", "version").agg(F.lit(1).alias("one")).groupBy("dep").agg(F.count("*").alias("versions"))
    return users.join(versions, "dep", "left").select("dep", "users", F.coalesce("versions", F.lit(0)).alias("versions"), (F.coalesce("versions", F.lit(0)) > 1).alias("mismatch"))


def dependency_members(uses: DataFrame) -> DataFrame:
    """(dep, project, version, newest, outdated): a row a user and version, with the package's greatest version. One
    row a use, however hot the package."""
    newest = uses.groupBy("dep").agg(F.max("version").alias("newest"))
    rows = uses.select("dep", "project", "version").distinct()
    return rows.join(newest, "dep").withColumn("outdated", F.col("version") < F.col("newest"))


def health(projects: DataFrame, commits: DataFrame, uses: DataFrame, sessions: DataFrame, branches: DataFrame, as_of: Column) -> DataFrame:
    """One row a project: inputs, score and label. A dependency is stale in a project where another
    project uses a greater version. Four pre-aggregated joins, no fan-out."""
    c = commits.groupBy("project").agg(F.max("date").alias("last"), F.count_if(F.col("date") >= as_of - F.expr("INTERVAL 30 DAYS")).alias("commits"))
    newest = uses.groupBy("dep").agg(F.max("version").alias("_top"))
    own = uses.groupBy("project", "dep").agg(F.max("version").alias("version")).join(newest, "dep")
    u = own.groupBy("project").agg(F.count("*").alias("dependencies"), F.count_if(F.col("version") < F.col("_top")).alias("stale"))
    s = sessions.where(F.col("ts") >= as_of - F.expr("INTERVAL 30 DAYS")).groupBy("project").agg(F.count("*").alias("sessions"))
    b = branches.groupBy("project").agg(F.count("*").alias("branches"))
    x = projects.join(c, "project", "left").join(u, "project", "left").join(s, "project", "left").join(b, "project", "left")
    x = x.fillna(0, ["commits", "dependencies", "stale", "sessions", "branches"]).withColumn("days", F.datediff(as_of, "last"))
    score = health_score(F.col("days"), F.col("commits"), F.col("stale"), F.col("dependencies"), F.col("sessions"), F.col("branches"))
    return x.withColumn("score", score).withColumn("label", health_label(F.col("score"), F.col("days"), F.col("commits"))).select("project", "days", "commits", "dependencies", "stale", "sessions", "branches", "score", "label")


def health_report(projects: DataFrame, commits: DataFrame, n: int = 10) -> DataFrame:
    """Projects with their last n commits, newest first."""
    return projects.join(top(commits, ["project"], [F.desc("date"), "sha"], n, "rank"), "project", "left")


def activity(commits: DataFrame, sessions: DataFrame, start: Column, n: int = 20) -> DataFrame:
    """The newest commits and sessions of each project, as a tagged union."""
    c = commits.where(F.col("date") >= start).select("project", F.lit("commit").alias("what"), F.col("sha").alias("id"), F.col("date").alias("ts"))
    s = sessions.where(F.col("ts") >= start).select("project", F.lit("session").alias("what"), F.col("session").cast("string").alias("id"), "ts")
    return top(c.union(s), ["project", "what"], [F.desc("ts"), "id"], n, "rank")


def stale(projects: DataFrame, commits: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Projects without activity for `days`; one without any shows the threshold."""
    last = commits.groupBy("project").agg(F.max("date").alias("last"))
    x = projects.join(last, "project", "left")
    gap = F.datediff(as_of, "last")
    return x.where(F.col("last").isNull() | (F.col("last") < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))).select("project", F.coalesce(gap, F.lit(int(days))).alias("inactive_days"))


def notable_name(name: Column) -> Column:
    """Packages that tell of a relation by their name: scoped ones, SDKs, clients and APIs."""
    return name.startswith("@") | name.contains("sdk") | name.contains("client") | name.contains("api")


def shared_packages(uses: DataFrame, notable: DataFrame | None = None, block: int | None = None, rows: int | None = None) -> DataFrame:
    """Project pairs a < b that share notable packages: shared count and confidence (high from three users
    of one package). Notable are given packages, by default all. Every pair of a package's users is given,
    so a package of n users makes n * (n - 1) / 2. Pairs are not shuffled: a grid of groups of projects (at most
    `block` in one, if given) makes them where both are. Uses may repeat; about how many there are can be given."""
    own = uses.select(F.col("dep").alias("set"), F.col("project").alias("member"))
    own = own if notable is None else own.join(notable.select(F.col("dep").alias("set")), "set", "left_semi")
    pairs = grid.shared_pairs(own, own.count() if rows is None else rows, block)
    return pairs.withColumn("confidence", F.when(F.col("users") >= 3, "high").otherwise("medium"))


def package_groups(uses: DataFrame, notable: DataFrame | None = None, block: int = 1000) -> dict[str, DataFrame]:
    """The relations of shared_packages without its square: `pairs` (a, b, shared, users, confidence) of projects
    that share packages of at most `block` users, exact, and `members` (dep, head, project, users, confidence) of larger
    packages, each user with the least as head. Two projects are related if they are a pair or members of one
    package. Output is linear in members for hot packages and at most block times the uses for others."""
    own = uses.select("project", "dep").distinct()
    own = own if notable is None else own.join(notable, "dep", "left_semi")
    size = saved(own.groupBy("dep").agg(F.count("*").alias("users"), F.min("project").alias("head")).where("users >= 2"), "packages")
    sure = F.when(F.col("users") >= 3, "high").otherwise("medium").alias("confidence")
    small = own.join(size.where(F.col("users") <= block), "dep")
    a, b = small.select("dep", "users", F.col("project").alias("a")), small.select("dep", F.col("project").alias("b"))
    pairs = a.join(b, "dep").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("users").alias("users"))
    members = own.join(size.where(F.col("users") > block), "dep").select("dep", "head", "project", "users", sure)
    return {"pairs": pairs.select("a", "b", "shared", "users", sure), "members": members}


def same_org(projects: DataFrame) -> DataFrame:
    """Pairs a < b whose remote URL has the same owner: each project with the least of its owner's, so an
    owner with many projects makes a star, not all pairs."""
    o = projects.select("project", F.lower(F.regexp_extract("remote", r"[:/]([^/:]+)/[^/]+?(?:\.git)?$", 1)).alias("org")).where("org <> ''")
    head = o.groupBy("org").agg(F.min("project").alias("a"))
    return o.join(head, "org").where("a <> project").select("a", F.col("project").alias("b"), "org")


def ancestors(path: Column) -> Column:
    """A path and every folder above it, as text: /a/b gives /a/b and /a. A trailing slash does not count."""
    clean = F.regexp_replace(path, "/+$", "")
    parts = F.split(clean, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.filter(F.coalesce(steps, F.array().cast("array<string>")), lambda p: p != "")


def resolved_path(base: Column, path: Column) -> Column:
    """A path, relative ones below base, without empty, `.` and `..` steps."""
    parts = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", base, path)), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", up(done)).otherwise(F.array_append(done, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def local_references(manifests: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, target): dependencies on a local path inside another project's folder; relative paths start at
    the project's own. Each path meets the projects at itself and its ancestors by equality."""
    p = projects.select(F.col("project").alias("target"), F.regexp_replace("path", "/+$", "").alias("_p"))
    m = manifests.where(F.col("version").rlike(r"^(file:|link:|\.{0,2}/)")).join(p.select(F.col("target").alias("project"), F.col("_p").alias("_base")), "project", "left")
    m = m.select("project", F.explode(ancestors(resolved_path(F.col("_base"), F.regexp_replace("version", "^(file:|link:)", "")))).alias("_p"))
    return m.join(p, "_p").where("project <> target").select("project", "target").distinct()


def relations(*kinds: DataFrame) -> DataFrame:
    """Relations (a, b, kind, confidence) of several detectors, once each: the first detector wins."""
    out = None
    for i, k in enumerate(kinds):
        k = k.select("a", "b", "kind", "confidence").withColumn("_i", F.lit(i))
        out = k if out is None else out.union(k)
    return out.groupBy("a", "b", "kind").agg(F.min_by("confidence", "_i").alias("confidence"))


def match_project(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """(session, project): the project with the longest path that holds or is held by the session's folder, of
    equal ones the greatest. Folders hold each other by whole names (/w/1 does not hold /w/10).

    A path meets the folders above it by equality, both ways round. Distinct folders are compared, and of the
    projects inside a folder only the longest path goes on, before sessions are joined."""
    folder = F.regexp_replace("dir", "/+$", "")
    dirs = sessions.select(folder.alias("dir")).where("dir <> ''").distinct()
    p = projects.select("project", F.regexp_replace("path", "/+$", "").alias("path")).where("path <> ''")
    best = F.max(F.struct(F.length("path").alias("n"), "project")).alias("best")
    above = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("path")).join(p, "path").groupBy("dir").agg(best)
    inside = p.select("project", "path", F.explode(ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(best).join(dirs, "dir", "left_semi")
    one = above.unionByName(inside).groupBy("dir").agg(F.max("best").alias("best"))
    return sessions.select("session", folder.alias("dir")).join(one, "dir").select("session", "best.project")


def report(projects: DataFrame, uses: DataFrame, edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts of nodes and edges, dependencies of more than one project, as (what, n)."""
    shared = uses.groupBy("dep").agg(F.count_distinct("project").alias("n")).where("n > 1")
    parts = {"projects": projects, "dependencies": uses.select("dep").distinct(), "uses": uses, "depends_on": edges, "sessions": sessions, "shared_dependencies": shared}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.union(one)
    return out


def build(spark, folder: str, frameworks: dict[str, str], as_of: Column) -> dict[str, DataFrame]:
    """A portfolio from landed files under `folder`: trees/, logs/, branches/, sessions/. One job graph of
    discovery, metadata, commits, dependencies, relations, sessions and health."""
    from mnemo.sources import readers as R

    deps = R.dependencies(spark, f"{folder}/trees")
    found = R.projects(spark, f"{folder}/trees", frameworks, deps)
    log = R.commits(spark, f"{folder}/logs").withColumn("project", F.regexp_replace("repo", r"\.\w+$", ""))
    br = R.branches(spark, f"{folder}/branches").withColumn("project", F.regexp_replace("repo", r"\.\w+$", ""))
    ses = R.session_metrics(R.sessions(spark, f"{folder}/sessions"))
    last = R.sessions(spark, f"{folder}/sessions").select("session", F.col("last").alias("ts"))
    ses = ses.join(last, "session")
    uses = deps.select("project", F.concat_ws(":", "ecosystem", "name").alias("dep"), "version")
    main = deps.where(~F.col("is_dev") & notable_name(F.col("name"))).select("project", F.concat_ws(":", "ecosystem", "name").alias("dep"))
    rel = shared_packages(main).select("a", "b", F.lit("shared_package").alias("kind"), "confidence")
    return {"projects": found, "commits": log, "branches": br, "dependencies": deps, "sessions": ses, "relations": relations(rel), "health": health(found, log, uses, ses, br, as_of)}
