"""Queries over requests, schemas, rooms and builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import builds, http, rooms, schema
from lodestrata.plans.registry import query
from lodestrata.plans.testbed import MESSAGES, REQUESTS, Bed, sql

# The catalog of the driver tables: columns by table, and foreign keys by name.
CATALOG = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity",
}
KEYS = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
_row = lambda r: "(" + ", ".join(f"'{x}'" for x in r) + ")"
FKS = f"fks(\"table\", \"column\", ref_table, ref_column) AS (VALUES {', '.join(map(_row, KEYS))})"
TABLES = f"tabs(name) AS (VALUES {', '.join(_row((t,)) for t in CATALOG)})"
COLUMNS = f"cols(\"table\", name) AS (VALUES {', '.join(_row((t, c)) for t, cs in CATALOG.items() for c in cs.split())})"


def _catalog(spark):
    return (
        spark.createDataFrame([(t,) for t in CATALOG], "name string"),
        spark.createDataFrame([(t, c) for t, cs in CATALOG.items() for c in cs.split()], "table string, name string"),
        spark.createDataFrame(KEYS, "table string, column string, ref_table string, ref_column string"),
    )


@query("j20_relations", sql(FKS, body="SELECT *, 'outgoing' AS direction FROM fks WHERE \"table\" = 'nation' UNION ALL SELECT *, 'incoming' FROM fks WHERE ref_table = 'nation'"))
def j20_relations(spark, d):
    return schema.relations(_catalog(spark)[2], "nation")


@query("j21_referenced_by", sql(TABLES, FKS, body="SELECT name, coalesce(r, []) AS referenced_by FROM tabs LEFT JOIN (SELECT ref_table, list(concat(\"table\", '.', \"column\") ORDER BY concat(\"table\", '.', \"column\")) AS r FROM fks GROUP BY ref_table) x ON x.ref_table = name"))
def j21_referenced_by(spark, d):
    t, _, k = _catalog(spark)
    return schema.referenced_by(t, k)


@query("f06_schema_search", sql(TABLES, COLUMNS, body="SELECT token, \"table\", kind FROM (SELECT name AS token, name AS \"table\", 'table' AS kind FROM tabs UNION ALL SELECT name, \"table\", 'column' FROM cols) WHERE contains(concat(token, ':', \"table\"), 'nation')"))
def f06_schema_search(spark, d):
    t, c, _ = _catalog(spark)
    return schema.search(schema.name_tokens(t, c), "NATION")


@query("j22_column_flags", sql(COLUMNS, body="SELECT \"table\", name, name IN ('r_regionkey', 'l_orderkey', 'l_linenumber') AS is_primary_key, name = 'r_regionkey' AS is_unique FROM cols"))
def j22_column_flags(spark, d):
    idx = spark.createDataFrame([("region", "pk", ["r_regionkey"], True, True), ("lineitem", "pk", ["l_orderkey", "l_linenumber"], True, True)], "table string, name string, columns array<string>, is_unique boolean, is_primary boolean")
    return schema.column_flags(_catalog(spark)[1], idx)


@query("s08_requests", sql(REQUESTS, body="SELECT id, method, path, status_code, started_at FROM requests WHERE status_code >= 300 ORDER BY started_at DESC, id DESC LIMIT 20"))
def s08_requests(spark, d):
    return http.summaries(http.list_requests(Bed(spark, d).requests(), status_min=300))


@query("a14_endpoints", sql(REQUESTS, body="SELECT pattern, min(id) FILTER (WHERE r = 1) AS first_id, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY started_at, id) AS r FROM (SELECT *, concat(method, ' ', regexp_replace(regexp_replace(path, '/[0-9]+', '/:id', 'g'), '^$', '')) AS pattern FROM requests)) GROUP BY pattern"))
def a14_endpoints(spark, d):
    return http.endpoints(Bed(spark, d).requests())


@query("w05_expiry", sql(REQUESTS, body="SELECT id, started_at + INTERVAL 30 MINUTE AS expires_at FROM requests WHERE started_at + INTERVAL 30 MINUTE > (SELECT max(started_at) FROM requests) - INTERVAL 1 DAY"))
def w05_expiry(spark, d):
    r = Bed(spark, d).requests()
    now = r.agg(F.max("started_at")).first()[0]
    return http.alive(http.with_expiry(r), F.lit(now).cast("timestamp_ntz") - F.expr("interval 1 day")).select("id", "expires_at")


@query("s09_read_since", sql(MESSAGES, body="SELECT * FROM messages WHERE room_id = 1 AND seq > 0 ORDER BY seq LIMIT 50"))
def s09_read_since(spark, d):
    return rooms.read_since(Bed(spark, d).messages(), 1)


@query("n04_room_sequence", "SELECT user_id AS room_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, CAST(event_id AS VARCHAR)) AS INTEGER) AS seq FROM events")
def n04_room_sequence(spark, d):
    m = Bed(spark, d).raw("events").select(F.col("user_id").alias("room_id"), "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("sender"), F.col("event_id").cast("string").alias("body"))
    return rooms.with_sequence(m).select("room_id", "event_id", "seq")


@query("r11_claims", "SELECT room_id, task_id, attempts, winner FROM (SELECT user_id AS room_id, event_id % 3 AS task_id, count(*) AS attempts FROM events WHERE event_type = 'click' GROUP BY 1, 2) a JOIN (SELECT room_id, task_id, winner FROM (SELECT user_id AS room_id, event_id % 3 AS task_id, CAST(event_id AS VARCHAR) AS winner, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, CAST(event_id AS VARCHAR)) AS r FROM events WHERE event_type = 'click') WHERE r = 1) b USING (room_id, task_id)")
def r11_claims(spark, d):
    e = Bed(spark, d).raw("events").select(F.col("user_id").alias("room_id"), (F.col("event_id") % 3).alias("task_id"), F.col("event_id").cast("string").alias("agent"), F.when(F.col("event_type") == "click", "claim").otherwise("update").alias("action"), F.col("ts").alias("at"))
    return rooms.claims(e)


@query("r12_reply_check", sql(MESSAGES, "m AS (SELECT room_id, seq, CASE WHEN seq % 2 = 0 THEN seq + 2 ELSE seq - 1 END AS reply_to FROM messages)", body="SELECT room_id, seq FROM m WHERE reply_to <= 0 OR (reply_to < seq AND EXISTS (SELECT 1 FROM m x WHERE x.room_id = m.room_id AND x.seq = m.reply_to))"))
def r12_reply_check(spark, d):
    m = Bed(spark, d).messages().withColumn("reply_to", F.when(F.col("seq") % 2 == 0, F.col("seq") + 2).otherwise(F.col("seq") - 1)).withColumn("reply_to", F.greatest("reply_to", F.lit(0)))
    m = m.withColumn("kind", F.lit("status")).withColumn("verdict", F.lit("")).withColumn("severity", F.lit(None).cast("string"))
    return rooms.accepted(m).select("room_id", "seq")


@query("j30_newest_room", "SELECT o_orderkey AS room_id, concat('run-', o_custkey) AS run_id, o_orderdate AS created_at FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def j30_newest_room(spark, d):
    r = Bed(spark, d).raw("orders").select(F.col("o_orderkey").alias("room_id"), F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return rooms.room_of_run(r, "run-7")


SHARES = "shares AS (SELECT p_type AS language, count(*) AS file_count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM part) AS share FROM part GROUP BY p_type)"


@query("a07_language_share", sql(SHARES, body="SELECT language, file_count, round(share, 9) AS share, CASE WHEN share >= 0.1 THEN 'primary' ELSE 'incidental' END AS tier FROM shares WHERE share >= 0.01"))
def a07_language_share(spark, d):
    counts = Bed(spark, d).raw("part").groupBy(F.col("p_type").alias("language")).agg(F.count("*").alias("file_count"))
    return builds.language_shares(counts).withColumn("share", F.round("share", 9))


@query("a08_fold_indexers", sql(SHARES, body="SELECT substr(language, 1, 1) AS indexer, CAST(sum(file_count) AS BIGINT) AS file_count, round(sum(share), 9) AS share, CASE WHEN max(share) >= 0.1 OR sum(share) >= 0.1 THEN 'primary' ELSE 'incidental' END AS tier FROM shares WHERE share >= 0.01 GROUP BY 1"))
def a08_fold_indexers(spark, d):
    counts = Bed(spark, d).raw("part").groupBy(F.col("p_type").alias("language")).agg(F.count("*").alias("file_count"))
    return builds.fold_indexers(builds.language_shares(counts), F.substring("language", 1, 1)).withColumn("share", F.round("share", 9))


@query("r09_change_detection", "SELECT l_orderkey AS path, CASE WHEN l_orderkey % 7 = 0 THEN 'active' WHEN l_orderkey % 7 = 1 THEN 'new' WHEN l_orderkey % 7 = 2 THEN 'truncated' WHEN l_orderkey % 7 = 3 THEN 'grown' ELSE 'unchanged' END AS state FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def r09_change_detection(spark, d):
    k = F.col("l_orderkey")
    base = Bed(spark, d).raw("lineitem").select("l_orderkey").distinct()
    t = lambda s: F.lit(s).cast("timestamp")
    files = base.select(k.alias("path"), F.lit(100).alias("size"), F.when(k % 7 == 0, t("2024-01-01 11:58:00")).otherwise(t("2024-01-01 10:00:00")).alias("mod_time"))
    cursors = base.where("l_orderkey % 7 <> 1").select(k.alias("path"), F.when(k % 7 == 2, 150).when(k % 7 == 3, 50).otherwise(100).alias("processed_bytes"), F.when(k % 7 == 2, t("2024-01-01 09:00:00")).otherwise(t("2024-01-01 10:00:00")).alias("mod_time"))
    return builds.change_state(files, cursors, t("2024-01-01 12:00:00")).select("path", "state")


@query("r13_batches", "SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 1000) AS BIGINT) AS batch FROM events")
def r13_batches(spark, d):
    return builds.batches(Bed(spark, d).raw("events").select("event_id"), 1000, "event_id").select("event_id", "batch")
