"""Queries over the cross-domain graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import git, graph
from lodestrata.plans.git_queries import CHURN, NUMBERED, PAIRS
from lodestrata.plans.registry import query
from lodestrata.plans.testbed import ADJ, CHANGES, COMMITS, EDGES, NODES, Bed, sql

DEG = "deg AS (SELECT node, count(*) AS degree FROM adj GROUP BY node)"
SIDES = "sides AS (SELECT file_a AS path, file_b AS other, count FROM pairs UNION ALL SELECT file_b, file_a, count FROM pairs WHERE file_a <> file_b)"
HOT = "hot AS (SELECT path FROM churn ORDER BY commit_count DESC, path LIMIT 500)"


@query("a05_degree", sql(EDGES, ADJ, DEG, body="SELECT * FROM deg"))
def a05_degree(spark, d):
    return graph.degrees(Bed(spark, d).edges())


@query("f05_node_search", sql(NODES, body="SELECT * FROM nodes WHERE contains(lower(name), 'an')"))
def f05_node_search(spark, d):
    return graph.search_nodes(Bed(spark, d).nodes(), "AN").select("type", "id", "name")


@query("g04_neighbors", sql(EDGES, ADJ, body="SELECT type, other FROM adj WHERE node = 'class:3'"))
def g04_neighbors(spark, d):
    return graph.neighbors(Bed(spark, d).edges(), "class:3")


@query("t06_god_nodes", sql(NODES, EDGES, ADJ, DEG, body="SELECT node, name, degree FROM (SELECT * FROM deg ORDER BY degree DESC, node LIMIT 10) d JOIN nodes n ON concat(n.type, ':', n.id) = d.node"))
def t06_god_nodes(spark, d):
    b = Bed(spark, d)
    return graph.god_nodes(b.nodes(), b.edges())


@query("t07_surprising_edges", sql(EDGES, body="SELECT src, type, dst, confidence, concat('cross-domain edge: ', split_part(src, ':', 1), ' → ', split_part(dst, ':', 1), ' (', type, ')') AS why FROM edges WHERE split_part(src, ':', 1) <> split_part(dst, ':', 1) AND confidence >= 0.8 ORDER BY confidence DESC, src, type, dst LIMIT 20"))
def t07_surprising_edges(spark, d):
    return graph.surprising_edges(Bed(spark, d).edges())


@query("j19_cochange_edges", sql(COMMITS, CHANGES, CHURN, NUMBERED, PAIRS, SIDES, HOT, body="SELECT 'changed_with' AS type, concat('file:', path) AS src, concat('file:', other) AS dst, least(CAST(1.0 AS DOUBLE), CAST(0.5 AS DOUBLE) + count * CAST(0.05 AS DOUBLE)) AS confidence, 'git' AS source_domain FROM (SELECT s.*, row_number() OVER (PARTITION BY path ORDER BY count DESC, other) AS r FROM sides s JOIN hot USING (path)) WHERE r <= 5 AND count >= 3"))
def j19_cochange_edges(spark, d):
    b = Bed(spark, d)
    return graph.cochange_edges(git.churn(b.changes(), b.commits()), git.cochange(b.changes(), b.commits()))


@query("j16_call_edges", sql(NODES, body="SELECT DISTINCT 'calls' AS type, concat('function:', s_suppkey) AS src, concat('class:', s_nationkey) AS dst, CAST(1.0 AS DOUBLE) AS confidence, 'code' AS source_domain FROM supplier JOIN nation ON n_nationkey = s_nationkey"))
def j16_call_edges(spark, d):
    b = Bed(spark, d)
    nodes = b.raw("supplier").select(F.lit("function").alias("type"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).union(b.raw("nation").select(F.lit("class"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    calls = b.raw("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("caller"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("callee"))
    twice = calls.union(calls)
    return graph.call_edges(nodes, twice).withColumn("src", F.replace("src", F.lit(":s"), F.lit(":"))).withColumn("dst", F.replace("dst", F.lit(":n"), F.lit(":")))


@query("a15_authors", sql(COMMITS, CHANGES, body="SELECT 'author' AS type, CAST(email AS VARCHAR) AS id, max(author) AS name FROM commits WHERE hash IN (SELECT hash FROM changes) GROUP BY email"))
def a15_authors(spark, d):
    b = Bed(spark, d)
    return graph.author_nodes(git.file_contributors(b.changes(), b.commits())).select("type", "id", "name")


@query("u04_distinct_nodes", sql(NODES, body="SELECT DISTINCT type, id, name FROM nodes"))
def u04_distinct_nodes(spark, d):
    n = Bed(spark, d).nodes()
    return graph.union_nodes(n, n).select("type", "id", "name")



@query("g01_distance", None)
def g01_distance(spark, d):
    """The number of steps from the first region to the first part."""
    b = Bed(spark, d)
    adj = graph.adjacency(b.edges()).select("node", "other").distinct()
    one = lambda k: spark.range(1).select(F.lit(k).alias("node"))
    return graph.shortest_path(adj, one("module:0"), one("table:1"))


@query("g06_named_path", None)
def g06_named_path(spark, d):
    b = Bed(spark, d)
    name = b.raw("supplier").where("s_suppkey = 1").first().s_name
    return graph.find_path(b.nodes(), b.edges(), b.raw("region").where("r_regionkey = 0").first().r_name, name)


LABELS = "labels AS (SELECT concat('class:', n_nationkey) AS node, concat('c', n_regionkey) AS community FROM nation UNION ALL SELECT concat('module:', r_regionkey), CASE WHEN r_regionkey = 0 THEN 'alone' ELSE concat('c', r_regionkey) END FROM region)"


@query("a12_community_sizes", sql(LABELS, body="SELECT community, count(*) AS size, min(node) AS first FROM labels GROUP BY community HAVING count(*) >= 2"))
def a12_community_sizes(spark, d):
    b = Bed(spark, d)
    c = lambda x: F.concat(F.lit("c"), F.col(x).cast("string"))
    n = b.raw("nation").select(F.concat(F.lit("class:"), F.col("n_nationkey").cast("string")).alias("node"), c("n_regionkey").alias("community"))
    r = b.raw("region").select(F.concat(F.lit("module:"), F.col("r_regionkey").cast("string")).alias("node"), F.when(F.col("r_regionkey") == 0, "alone").otherwise(c("r_regionkey")).alias("community"))
    return graph.community_records(n.union(r)).select("community", "size", "first")


@query("g03_communities", None)
def g03_communities(spark, d):
    b = Bed(spark, d)
    return graph.communities(b.nodes(), b.edges())


@query("a16_report", sql(NODES, EDGES, ADJ, DEG, "labels AS (SELECT concat('class:', n_nationkey) AS node, n_regionkey AS community FROM nation)", body="SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM (SELECT community FROM labels GROUP BY 1 HAVING count(*) >= 2)) AS community_count, (SELECT max(degree) FROM deg) AS top_degree, (SELECT least(20, count(*)) FROM edges WHERE split_part(src, ':', 1) <> split_part(dst, ':', 1) AND confidence >= 0.8) AS surprising_count"))
def a16_report(spark, d):
    b = Bed(spark, d)
    labels = b.raw("nation").select(F.concat(F.lit("class:"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_regionkey").alias("community"))
    return graph.report(b.nodes(), b.edges(), labels)
