"""The graph model built from the generated star schema, and the same tables as SQL views.

Every table is a projection or an equi-join of whole source tables, so filters reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.operators.frames import dealt, only, saved

AS_OF_EVENTS, AS_OF_ORDERS = "2024-01-31 00:00:00", "2001-01-01 00:00:00"


class Tables:
    """Lazy DataFrames of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._lines = spark, sf_dir, None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> int:
        """Rows of lineitem, from the footers."""
        if self._lines is None:
            self._lines = self.raw("lineitem").count()
        return self._lines

    def pairs(self) -> int:
        """About so many pairs of entities that atoms mention: an atom has four mentions on the average."""
        return 2 * self.lines()

    def activities(self) -> DataFrame:
        return self.raw("events").select(F.lit("events").alias("source"), F.col("event_id").alias("source_id"), "ts", F.col("event_type").alias("kind"), F.col("props").alias("snippet"), F.col("user_id").alias("person"), F.get_json_object("props", "$.k").alias("topic"), "value")

    def persons(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("container"))

    def containers(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("container"), F.col("n_name").alias("container_name"))

    def atoms(self) -> DataFrame:
        p = F.substring("o_orderpriority", 1, 1)
        return self.raw("orders").select(F.col("o_orderkey").alias("atom"), F.col("o_orderdate").alias("created_at"), F.when(p.isin("1", "2"), "high").when(p == "3", "normal").otherwise("low").alias("salience"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("cwd"))

    def entities(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))

    def mentions(self) -> DataFrame:
        """One row an atom and entity: prominence in fiftieths (a whole number), the most of its lines. Dealt by atom,
        since few rows of an atom combine."""
        x = self.raw("lineitem").select(F.col("l_orderkey").alias("atom"), F.col("l_partkey").alias("entity"), F.col("l_quantity").cast("long").alias("prominence"))
        return dealt(x, self.lines(), "atom").groupBy("atom", "entity").agg(F.max("prominence").alias("prominence"))

    def assoc(self) -> DataFrame:
        """Undirected pairs a < b of entities with the number of atoms that mention both. Atoms hold at most
        seven entities, so the self-join is linear in the mentions."""
        m = self.mentions().select("atom", "entity")
        a, b = m.toDF("atom", "a"), m.toDF("atom", "b")
        return dealt(a.join(b, "atom").where("a < b").select("a", "b"), self.pairs(), "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))

    def ways(self, nodes: DataFrame) -> DataFrame:
        """The associations (src, dst, weight) of distinct nodes (entity), as both_ways(assoc()) has them. Only atoms that
        mention a node are paired, so that few nodes cost passes over the lines and not all pairs."""
        x = self.raw("lineitem").select(F.col("l_orderkey").alias("atom"), F.col("l_partkey").alias("entity"))
        own = saved(only(x, nodes, "entity"), "own")
        rows = 5 * own.count()  # an atom of a node has, on the average, four mentions beside it
        near = dealt(only(x, own, "atom"), rows, "atom").distinct()
        pairs = dealt(own, rows, "atom").distinct().withColumnRenamed("entity", "src").join(near.withColumnRenamed("entity", "dst"), "atom")
        return dealt(pairs.where("src <> dst").select("src", "dst"), rows, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))

    def accesses(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("atom"), F.col("l_shipdate").alias("ts"), (F.col("l_quantity") / 50).alias("weight"), "l_linenumber")

    # clinical
    def diagnoses(self) -> DataFrame:
        """A condition (part type) a patient has from its first to its last order."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey")
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        p = self.raw("part").select("p_partkey", "p_type")
        return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("patient"), F.col("p_type").alias("condition"), F.to_date("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(F.date_add("o_orderdate", 30)).alias("stop"), F.col("o_orderkey").alias("encounter"))

    def prescriptions(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity", "l_linestatus")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        p = self.raw("part").select("p_partkey", "p_brand", "p_type")
        return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("patient"), F.col("p_brand").alias("drug"), F.to_date("l_shipdate").alias("start"), F.when(F.col("l_linestatus") != "O", F.date_add("l_shipdate", F.col("l_quantity").cast("int"))).alias("stop"), F.col("l_orderkey").alias("encounter"), F.col("l_linenumber").alias("line"), F.col("p_type").alias("reason"))

    def labs(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("patient"), F.col("event_type").alias("code"), F.to_date("ts").alias("date"), "value", F.col("event_id").alias("id"))

    def patients(self) -> DataFrame:
        """Birth dates spread over the years from the key, gender from its parity."""
        k = F.col("c_custkey")
        return self.raw("customer").select(k.alias("patient"), F.col("c_name").alias("name"), F.date_add(F.lit("1930-01-01").cast("date"), ((k * 37) % 25000).cast("int")).alias("birth"), F.when(k % 2 == 0, "F").otherwise("M").alias("gender"))

    # research
    def research(self) -> DataFrame:
        """Mentions of suppliers: entity, domain (region), event (order), role, trend (part type), date."""
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate", "l_returnflag")
        s = self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_regionkey").join(self.raw("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        s = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        p = self.raw("part").select("p_partkey", "p_type")
        return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_name").alias("entity"), F.col("r_name").alias("domain"), F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("role"), F.col("p_type").alias("trend"), F.col("l_shipdate").alias("date"))

    # portfolio
    def lines_of_uses(self) -> DataFrame:
        """(project, dep), once a line: for what takes them as a set."""
        return self.raw("lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("dep"))

    def uses(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("dep"), F.col("l_linenumber").cast("string").alias("version")).distinct()

    def commits(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_suppkey").alias("project"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("sha"), F.col("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("insertions"))

    def steps_of_orders(self) -> DataFrame:
        """(src, dst), which may repeat: the supplier of a line depends on that of the order's next line. Dealt by order, so
        that lines are shuffled once for what is distinct and what is next. For what takes steps as a set."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
        li = dealt(self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), self.lines(), "l_orderkey").distinct()
        return li.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst")).where("dst is not null and src <> dst")

    def depends_on(self) -> DataFrame:
        """The distinct steps from a supplier to the next."""
        return self.steps_of_orders().distinct()


VIEWS = {
    "activities": "SELECT 'events' AS source, event_id AS source_id, ts, event_type AS kind, props AS snippet, user_id AS person, json_extract_string(props, '$.k') AS topic, value FROM events",
    "persons": "SELECT c_custkey AS person, c_name AS name, c_nationkey AS container FROM customer",
    "containers": "SELECT n_nationkey AS container, n_name AS container_name FROM nation",
    "atoms": "SELECT o_orderkey AS atom, o_orderdate AS created_at, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'normal' ELSE 'low' END AS salience, o_orderstatus AS kind, o_custkey AS cwd FROM orders",
    "entities": "SELECT p_partkey AS entity, p_name AS name, p_type AS type FROM part",
    "mentions": "SELECT l_orderkey AS atom, l_partkey AS entity, max(l_quantity::BIGINT) AS prominence FROM lineitem GROUP BY ALL",
    "assoc": "SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM mentions x JOIN mentions y ON x.atom = y.atom AND x.entity < y.entity GROUP BY ALL",
    "diagnoses": "SELECT o_custkey AS patient, p_type AS condition, o_orderdate::DATE AS start, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 30 END AS stop, o_orderkey AS encounter FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
    "prescriptions": "SELECT o_custkey AS patient, p_brand AS drug, l_shipdate::DATE AS start, CASE WHEN l_linestatus <> 'O' THEN l_shipdate::DATE + l_quantity::INT END AS stop, l_orderkey AS encounter, l_linenumber AS line, p_type AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
    "labs": "SELECT user_id AS patient, event_type AS code, ts::DATE AS date, value, event_id AS id FROM events",
    "patients": "SELECT c_custkey AS patient, c_name AS name, DATE '1930-01-01' + ((c_custkey * 37) % 25000)::INT AS birth, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer",
    "research": "SELECT s_name AS entity, r_name AS domain, l_orderkey AS event, l_returnflag AS role, p_type AS trend, l_shipdate AS date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey",
    "uses": "SELECT DISTINCT l_suppkey AS project, l_partkey AS dep, l_linenumber::VARCHAR AS version FROM lineitem",
    "commits": "SELECT l_suppkey AS project, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS sha, l_shipdate AS date, l_quantity::BIGINT AS insertions FROM lineitem",
    "depends_on": "SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS dst FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem)) WHERE dst IS NOT NULL AND src <> dst",
}


def sql(body: str, *names: str) -> str:
    """A query over the named views (assoc brings mentions)."""
    names = list(dict.fromkeys((["mentions"] if "assoc" in names else []) + list(names)))
    # joins that are read several times are made once
    head = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ('mentions', 'assoc') else ''}({VIEWS[n]})" for n in names)
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
