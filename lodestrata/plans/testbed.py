"""The driver tables seen as tables of the domains, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Bed:
    """The domain tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def commits(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("email"), F.concat(F.lit("author "), F.col("o_custkey").cast("string")).alias("author"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("message"))

    def changes(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("removed"))

    def blame(self) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"))
        return self.raw("lineitem").select(F.col("l_partkey").alias("path"), n.alias("line"), F.col("l_orderkey").alias("commit"), F.col("l_shipdate").alias("date"))

    def symbols(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("display_name"), F.col("p_type").alias("kind"))

    def occurrences(self) -> DataFrame:
        first = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")) == 1
        return self.raw("lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), first.alias("is_definition"))

    def calls(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee")).distinct()

    def impls(self) -> DataFrame:
        p = self.raw("part")
        base = p.groupBy("p_brand").agg(F.min("p_partkey").alias("base"))
        return p.join(base, "p_brand").where("p_partkey <> base").select("base", F.col("p_partkey").alias("impl"))

    def coverage(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.col("l_partkey").alias("symbol")).agg(F.sum(F.col("l_quantity").cast("long")).alias("hit_count"))

    def spans(self) -> DataFrame:
        """Definitions: a part is a file, each of its order lines a one-line span by ship day."""
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
        return self.raw("lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol"), day.alias("line"), day.alias("end_line")).groupBy("file", "symbol").agg(F.min("line").alias("line"), F.min("end_line").alias("end_line"))

    def ranges(self) -> DataFrame:
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
        return self.raw("lineitem").select(F.col("l_suppkey").alias("file"), day.alias("line"), (day + 3).alias("end_line"), F.col("l_quantity").cast("long").alias("count"))

    def requests(self) -> DataFrame:
        k = F.get_json_object("props", "$.k")
        status = (F.pmod(F.col("event_id"), F.lit(5)) * 100 + 100).cast("int")
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("method"), F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), F.coalesce(k, F.lit(""))).alias("path"), status.alias("status_code"), F.col("ts").alias("started_at"))

    def nodes(self) -> DataFrame:
        def node(table, kind, ident, name):
            return self.raw(table).select(F.lit(kind).alias("type"), F.col(ident).cast("string").alias("id"), F.col(name).alias("name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"))

        return node("region", "module", "r_regionkey", "r_name").union(node("nation", "class", "n_nationkey", "n_name")).union(node("supplier", "function", "s_suppkey", "s_name")).union(node("part", "table", "p_partkey", "p_name"))

    def edges(self) -> DataFrame:
        def edge(rows, kind, src, dst, conf):
            return rows.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), conf.cast("double").alias("confidence"), F.lit("code").alias("source_domain"))

        k = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
        supplies = self.raw("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
        a = edge(self.raw("nation"), "in", k("class", "n_nationkey"), k("module", "n_regionkey"), F.lit(1.0))
        b = edge(self.raw("supplier"), "of", k("function", "s_suppkey"), k("class", "s_nationkey"), F.lit(0.9))
        return a.union(b).union(edge(supplies, "uses", k("function", "l_suppkey"), k("table", "l_partkey"), F.least(F.lit(1.0), 0.5 + F.col("n") * 0.125)))

    def facts(self) -> DataFrame:
        """Assertions: a user is about the k of an event, by event type."""
        return self.raw("events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("relation"), F.concat(F.lit("k-"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))).alias("dst"), F.col("ts").alias("at"), F.col("event_id").alias("episode"))

    def entities(self) -> DataFrame:
        return self.raw("customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.array(F.col("c_mktsegment"), F.concat(F.lit("cust "), F.col("c_custkey").cast("string"))).alias("aliases"))

    def messages(self) -> DataFrame:
        return self.raw("conversations").select(F.col("conv_id").alias("room_id"), F.col("turn").alias("seq"), F.col("role").alias("sender"), F.col("text").alias("body"))


# The same in SQL, as the beginning of a WITH clause.
COMMITS = "commits AS (SELECT o_orderkey AS hash, o_custkey AS email, concat('author ', o_custkey) AS author, o_orderdate AS date, o_orderpriority AS message FROM orders)"
CHANGES = "changes AS (SELECT l_orderkey AS hash, l_partkey AS path, CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS removed FROM lineitem)"
BLAME = "blame AS (SELECT l_partkey AS path, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS line, l_orderkey AS commit, l_shipdate AS date FROM lineitem)"
SYMBOLS = "symbols AS (SELECT p_partkey AS symbol, p_name AS display_name, p_type AS kind FROM part)"
OCCURRENCES = "occurrences AS (SELECT l_partkey AS symbol, l_orderkey AS file, l_linenumber AS line, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) = 1 AS is_definition FROM lineitem)"
CALLS = "calls AS (SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee FROM lineitem)"
IMPLS = "impls AS (SELECT b.base, p.p_partkey AS impl FROM part p JOIN (SELECT p_brand, min(p_partkey) AS base FROM part GROUP BY p_brand) b ON b.p_brand = p.p_brand WHERE p.p_partkey <> b.base)"
COVERAGE = "coverage AS (SELECT l_partkey AS symbol, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS hit_count FROM lineitem GROUP BY l_partkey)"
DAY = "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"
SPANS = f"spans AS (SELECT l_suppkey AS file, l_partkey AS symbol, min({DAY}) AS line, min({DAY}) AS end_line FROM lineitem GROUP BY 1, 2)"
RANGES = f"ranges AS (SELECT l_suppkey AS file, {DAY} AS line, {DAY} + 3 AS end_line, CAST(l_quantity AS BIGINT) AS count FROM lineitem)"
K = "coalesce(json_extract_string(props, '$.k'), {})"
REQUESTS = f"requests AS (SELECT event_id AS id, event_type AS method, concat('/u/', user_id, '/', {K.format(chr(39) * 2)}) AS path, CAST(event_id % 5 * 100 + 100 AS INTEGER) AS status_code, ts AS started_at FROM events)"
NODES = "nodes AS (SELECT 'module' AS type, CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region UNION ALL SELECT 'class', CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION ALL SELECT 'function', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'table', CAST(p_partkey AS VARCHAR), p_name FROM part)"
EDGES = "edges AS (SELECT 'in' AS type, concat('class:', n_nationkey) AS src, concat('module:', n_regionkey) AS dst, CAST(1.0 AS DOUBLE) AS confidence FROM nation UNION ALL SELECT 'of', concat('function:', s_suppkey), concat('class:', s_nationkey), CAST(0.9 AS DOUBLE) FROM supplier UNION ALL SELECT 'uses', concat('function:', l_suppkey), concat('table:', l_partkey), least(CAST(1.0 AS DOUBLE), CAST(0.5 AS DOUBLE) + count(*) * CAST(0.125 AS DOUBLE)) FROM lineitem GROUP BY l_suppkey, l_partkey)"
ADJ = "adj AS (SELECT src AS node, type, dst AS other FROM edges UNION SELECT dst, type, src FROM edges)"
FACTS = f"assertions AS (SELECT concat('user-', user_id) AS src, event_type AS relation, concat('k-', {K.format(chr(39) + 'none' + chr(39))}) AS dst, ts AS asserted, event_id AS episode FROM events)"
ENTITIES = "entities AS (SELECT concat('user-', c_custkey) AS slug, c_name AS name, c_mktsegment AS type, [c_mktsegment, concat('cust ', c_custkey)] AS aliases FROM customer)"
MESSAGES = "messages AS (SELECT conv_id AS room_id, turn AS seq, role AS sender, text AS body FROM conversations)"


def sql(*views: str, body: str) -> str:
    return f"WITH {', '.join(views)} {body}"
