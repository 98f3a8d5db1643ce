"""The cross-domain graph: building, degree, search, paths, communities, report.

nodes: type, id, name, file, line; edges: type, src, dst, confidence,
source_domain; src and dst are node keys ``type:id``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.predicates import contains_text, node_type
from lodestrata.functions.scalars import edge_label
from lodestrata.operators.code import first_definitions
from lodestrata.plans.storage import checkpointed

NODE = ("type", "id", "name", "file", "line")
EDGE = ("type", "src", "dst", "confidence", "source_domain")
MAX_DEPTH, GOD_NODES, SURPRISING = 10, 10, 20
#: So many nodes (three numbers each) may go through the driver in a pass.
BROADCAST_NODES = 2_000_000


def key(kind: Column | str, ident: Column | str) -> Column:
    return F.concat_ws(":", kind, ident)


def _node(kind, ident, name, file=None, line=None) -> list[Column]:
    none = F.lit(None)
    return [F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), ident.cast("string").alias("id"), name.cast("string").alias("name"), (none.cast("string") if file is None else file.cast("string")).alias("file"), (none.cast("long") if line is None else line.cast("long")).alias("line")]


def _edge(kind: str, src: Column, dst: Column, confidence: Column, domain: str) -> list[Column]:
    return [F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), confidence.cast("double").alias("confidence"), F.lit(domain).alias("source_domain")]


def code_nodes(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Symbols of the known kinds with their first definition."""
    rows = symbols.withColumn("t", node_type("kind")).where("t is not null").join(first_definitions(occurrences), "symbol", "left")
    return rows.select(*_node(F.col("t"), F.col("symbol"), F.col("display_name"), F.col("file"), F.col("line")))


def call_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls whose ends are both nodes, each once."""
    return _between(nodes, calls.select(F.col("caller").alias("a"), F.col("callee").alias("b")), "calls", 1.0)


def impl_edges(nodes: DataFrame, impls: DataFrame) -> DataFrame:
    """From the implementation to its base, each once."""
    return _between(nodes, impls.select(F.col("impl").alias("a"), F.col("base").alias("b")), "implements", 1.0)


def _between(nodes: DataFrame, pairs: DataFrame, kind: str, confidence: float) -> DataFrame:
    known = nodes.select("id", key("type", "id").alias("k"))
    p = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).distinct()
    src, dst = known.select(F.col("id").alias("a"), F.col("k").alias("ka")), known.select(F.col("id").alias("b"), F.col("k").alias("kb"))
    return p.join(src, "a").join(dst, "b").select(*_edge(kind, F.col("ka"), F.col("kb"), F.lit(confidence), "code")).distinct()


def fk_edges(foreign_keys: DataFrame) -> DataFrame:
    """Between tables; the target need not exist."""
    return foreign_keys.select(*_edge("fk", key(F.lit("table"), F.col("table")), key(F.lit("table"), F.col("ref_table")), F.lit(1.0), "schema")).distinct()


def cochange_edges(churn: DataFrame, pairs: DataFrame, hot: int = 500, each: int = 5, least: int = 3) -> DataFrame:
    """For each of the hottest files its most frequent companions; the edge leads to the other file."""
    top = churn.orderBy(F.desc("commit_count"), "path").limit(hot).select("path")
    both = pairs.select(F.col("file_a").alias("path"), F.col("file_b").alias("other"), "count").union(pairs.where("file_a <> file_b").select("file_b", "file_a", "count"))
    ranked = both.join(top, "path").withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("count"), "other"))).where((F.col("r") <= each) & (F.col("count") >= least))
    return ranked.select(*_edge("changed_with", key(F.lit("file"), F.col("path")), key(F.lit("file"), F.col("other")), F.least(F.lit(1.0), 0.5 + F.col("count") * 0.05), "git"))


def author_nodes(contributors: DataFrame) -> DataFrame:
    """Each author once, with the name of the record with most commits."""
    rows = contributors.groupBy("email").agg(F.max_by("author", F.struct("commit_count", "author")).alias("author"))
    return rows.select(*_node("author", F.col("email"), F.col("author")))


def endpoint_nodes(endpoints: DataFrame) -> DataFrame:
    return endpoints.select(*_node("endpoint", F.col("pattern"), F.col("pattern")))


def union_nodes(*parts: DataFrame) -> DataFrame:
    """The nodes of all domains, each key once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("type", "id").agg(F.min(F.struct("name", "file", "line")).alias("r")).select("type", "id", "r.*")


def adjacency(edges: DataFrame) -> DataFrame:
    """node, type, other: both directions of every edge, each once; a loop once."""
    return edges.select(F.col("src").alias("node"), "type", F.col("dst").alias("other")).union(edges.select("dst", "type", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """A05."""
    return adjacency(edges).groupBy("node").agg(F.count("*").alias("degree"))


def search_nodes(nodes: DataFrame, q: str) -> DataFrame:
    """nodes whose name holds the query, whatever its case."""
    return nodes.where(contains_text("name", q))


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """One row for each edge type and neighbour."""
    return adjacency(edges).where(F.col("node") == node).select("type", "other")


def god_nodes(nodes: DataFrame, edges: DataFrame, limit: int = GOD_NODES) -> DataFrame:
    """The nodes of largest degree; ends of dangling edges are none."""
    known = nodes.withColumn("node", key("type", "id"))
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(limit).join(known, "node").select("node", "name", "degree")


def surprising_edges(edges: DataFrame, limit: int = SURPRISING) -> DataFrame:
    """Sure edges between node types."""
    kind = lambda c: F.substring_index(c, ":", 1)
    rows = edges.where((kind("src") != kind("dst")) & (F.col("confidence") >= 0.8))
    why = F.concat(F.lit("cross-domain edge: "), kind("src"), F.lit(" → "), kind("dst"), F.lit(" ("), F.col("type"), F.lit(")"))
    return rows.select("src", "type", "dst", "confidence", why.alias("why")).orderBy(F.desc("confidence"), "src", "type", "dst").limit(limit)


def shortest_path(adjacent: DataFrame, sources: DataFrame, targets: DataFrame, most: int | None = MAX_DEPTH) -> DataFrame:
    """Node, depth of one shortest path between two sets (node); empty if there is none.

    adjacent: node, other.  Level by level: the frontier is joined with the edges and
    what has been visited goes out; each level is written, so lineage stays short.
    A target is looked for at depths 0 .. most - 1; among several of one depth, and
    among several predecessors, the smallest key counts.
    """
    spark = adjacent.sparkSession
    frontier = checkpointed(sources.select("node").distinct().select("node", F.lit(None).cast("string").alias("prev"), F.lit(0).alias("depth")))
    visited, depth = frontier, 0
    while most is None or depth < most:
        hit = frontier.join(targets.select("node").distinct(), "node").orderBy("node").limit(1).collect()
        if hit:
            at, path = hit[0].node, []
            for d in range(depth, -1, -1):
                path.append((at, d))
                at = visited.where((F.col("node") == at) & (F.col("depth") == d)).first().prev
            return spark.createDataFrame(path, "node string, depth int")
        step = frontier.join(adjacent, "node").groupBy(F.col("other").alias("n")).agg(F.min("node").alias("prev"))
        frontier = checkpointed(step.join(visited, step["n"] == visited["node"], "left_anti").select(F.col("n").alias("node"), "prev", F.lit(depth + 1).alias("depth")))
        if frontier.limit(1).count() == 0:
            break
        visited, depth = checkpointed(visited.union(frontier)), depth + 1
    return spark.createDataFrame([], "node string, depth int")


def find_path(nodes: DataFrame, edges: DataFrame, from_q: str, to_q: str) -> DataFrame:
    """The path between nodes found by name, as shown, with what each step is called."""
    known = nodes.withColumn("node", key("type", "id"))
    named = lambda q: search_nodes(known, q).select("node")
    path = shortest_path(adjacency(edges).select("node", "other").distinct(), named(from_q), named(to_q))
    shown = path.join(known.select("node", F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(")")).alias("shown")), "node", "left")
    kind = F.substring_index("node", ":", 1)
    after = F.lead(kind).over(Window.orderBy("depth"))  # a path has ten nodes at most
    return shown.select("depth", "node", F.coalesce("shown", "node").alias("shown"), F.when(after.isNotNull(), edge_label(kind, after)).alias("edge"))


def communities(nodes: DataFrame, edges: DataFrame, passes: int = 20) -> DataFrame:
    """Node and community by local moving on weighted edges, for graphs of any size.

    In each pass every node looks at the communities of its neighbours and would move
    to the one of largest gain (w_ic - w_own) - k_i (S_c - S_own + k_i) / 2m, ties to
    the smaller community.  To keep simultaneous moves from swapping, only moves to a
    smaller community id are made in even passes and to a larger one in odd passes.

    Nodes are numbered in the order of their keys.  The edges lie by node on the
    executors' disks; up to BROADCAST_NODES nodes a pass sends out where each one is,
    so edges are neither sorted nor shuffled in a pass; beyond, they are joined.
    """
    spark = nodes.sparkSession
    known = checkpointed(nodes.select(key("type", "id").alias("node")).distinct().orderBy("node").withColumn("i", F.monotonically_increasing_id()))
    sent = F.broadcast if known.count() <= BROADCAST_NODES else lambda df: df
    w = edges.where("src <> dst").join(sent(known.select(F.col("node").alias("src"), F.col("i").alias("a"))), "src").join(sent(known.select(F.col("node").alias("dst"), F.col("i").alias("b"))), "dst")
    both = w.select(F.col("a").alias("node"), F.col("b").alias("other"), "confidence").union(w.select("b", "a", "confidence"))
    # as many parts as a shuffle has, so that what is kept stays dealt by node
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adj = both.repartition(parts, "node").groupBy("node", "other").agg(F.sum("confidence").alias("w")).persist(StorageLevel.DISK_ONLY)
    try:
        strength = checkpointed(adj.groupBy("node").agg(F.sum("w").alias("k")))
        twice = strength.agg(F.sum("k")).first()[0]
        at = checkpointed(known.select(F.col("i").alias("node"), F.col("i").alias("c")).join(strength, "node", "left"))
        idle = 0
        for p in range(passes if twice else 0):
            total = at.where("k is not null").groupBy("c").agg(F.sum("k").alias("s"))
            # where each node with edges is: node, c, k, s
            placed = checkpointed(at.where("k is not null").join(total, "c").select("node", "c", "k", "s"))
            near = adj.join(sent(placed.select(F.col("node").alias("other"), "c", "s")), "other").groupBy("node", "c").agg(F.sum("w").alias("wic"), F.max("s").alias("s"))
            own = placed.select("node", F.col("c").alias("own"), "k", F.col("s").alias("s_own"))
            inside = F.max(F.when(F.col("c") == F.col("own"), F.col("wic"))).over(Window.partitionBy("node"))
            options = near.join(own, "node").withColumn("w_own", inside)
            gain = (F.col("wic") - F.coalesce("w_own", F.lit(0.0))) - F.col("k") * (F.col("s") - F.col("s_own") + F.col("k")) / twice
            way = F.col("c") < F.col("own") if p % 2 == 0 else F.col("c") > F.col("own")
            best = options.withColumn("gain", gain).where(way & (F.col("gain") > 1e-12)).groupBy("node").agg(F.min_by("c", F.struct(-F.col("gain"), "c")).alias("to"))
            moved = checkpointed(at.join(best, "node", "left"))
            idle = 0 if moved.where("to is not null").limit(1).count() else idle + 1
            at = moved.select("node", F.coalesce("to", "c").alias("c"), "k")
            if idle == 2:
                break
    finally:
        adj.unpersist()
    named = at.join(known.select(F.col("i").alias("node"), F.col("node").alias("name")), "node")
    return named.join(known.select(F.col("i").alias("c"), F.col("node").alias("community")), "c").select(F.col("name").alias("node"), "community")


def community_records(labels: DataFrame) -> DataFrame:
    """Communities of two nodes or more, largest first, with a label.

    The label is the common path of the file, function and class members, else the
    commonest type (of equals the first by name).
    """
    parts = labels.withColumn("t", F.substring_index("node", ":", 1)).withColumn("p", F.when(F.col("t").isin("file", "function", "class"), F.expr("substring(node, instr(node, ':') + 1)")))
    kinds = parts.groupBy("community", "t").agg(F.count("*").alias("n")).groupBy("community").agg(F.max_by("t", F.struct("n", (-F.ascii("t")).alias("first"))).alias("t"))
    sums = parts.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("first"), F.count("p").alias("paths"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    rows = sums.where("size >= 2").join(kinds, "community")
    a, b = F.split("lo", "/"), F.split("hi", "/")
    shared = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))
    prefix = F.when(F.col("paths") > 1, F.array_join(F.slice(a, F.lit(1), F.size(shared)), "/"))
    cluster = F.concat(F.col("t"), F.lit(" cluster ("), F.col("size").cast("string"), F.lit(" nodes)"))
    return rows.select("community", "size", "first", F.when(F.coalesce(prefix, F.lit("")).isin("", "/"), cluster).otherwise(prefix).alias("label"))


def report(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: counts, the largest degree, surprising edges."""
    god = god_nodes(nodes, edges)
    parts = [nodes.agg(F.count("*").alias("v")).withColumn("k", F.lit("node_count")), edges.agg(F.count("*").alias("v")).withColumn("k", F.lit("edge_count")), community_records(labels).agg(F.count("*").alias("v")).withColumn("k", F.lit("community_count")), god.agg(F.max("degree").alias("v")).withColumn("k", F.lit("top_degree")), surprising_edges(edges).agg(F.count("*").alias("v")).withColumn("k", F.lit("surprising_count"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy().pivot("k", ["node_count", "edge_count", "community_count", "top_degree", "surprising_count"]).agg(F.first("v"))


def build(code: dict[str, DataFrame], git: dict[str, DataFrame], foreign_keys: DataFrame, tables: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all four domains.

    code: symbols, occurrences, calls, impls; git: churn, contributors, pairs;
    tables: name; endpoints: pattern.
    """
    symbols = code_nodes(code["symbols"], code["occurrences"])
    files = git["churn"].select(*_node("file", F.col("path"), F.col("path")))
    schemas = tables.select(*_node("table", F.col("name"), F.col("name")))
    nodes = union_nodes(symbols, files, author_nodes(git["contributors"]), schemas, endpoint_nodes(endpoints))
    edges = call_edges(symbols, code["calls"])
    for more in (impl_edges(symbols, code["impls"]), fk_edges(foreign_keys), cochange_edges(git["churn"], git["pairs"])):
        edges = edges.unionByName(more)
    return nodes, edges
