"""Queries over code symbols and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import predicates as P
from lodestrata.functions import scalars as S
from lodestrata.operators import code, git
from lodestrata.plans.registry import query
from lodestrata.plans.testbed import CALLS, COVERAGE, IMPLS, OCCURRENCES, RANGES, SPANS, SYMBOLS, Bed, sql

#: One of the names of sf0.001 and above, in another case; several symbols have it.
NAME = "(SELECT display_name FROM symbols WHERE symbol = 1)"
HITS = f"hits AS (SELECT * FROM symbols WHERE lower(display_name) = lower({NAME}))"
FIRST = "firsts AS (SELECT symbol, file, line FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY file, line) AS r FROM occurrences WHERE is_definition) WHERE r = 1)"


def _name(b: Bed) -> str:
    return b.symbols().where("symbol = 1").first().display_name.upper()


@query("f01_name_lookup", sql(SYMBOLS, HITS, body="SELECT * FROM hits"))
def f01_name_lookup(spark, d):
    b = Bed(spark, d)
    return code.by_name(b.symbols(), _name(b))


@query("j01_refs", sql(SYMBOLS, OCCURRENCES, HITS, body="SELECT h.symbol, display_name, kind, file, line, is_definition FROM hits h LEFT JOIN (SELECT * FROM occurrences WHERE NOT is_definition) o ON o.symbol = h.symbol"))
def j01_refs(spark, d):
    b = Bed(spark, d)
    return code.refs(b.symbols(), b.occurrences(), _name(b))


@query("j01_defs", sql(SYMBOLS, OCCURRENCES, HITS, body="SELECT h.symbol, display_name, kind, file, line, is_definition FROM hits h LEFT JOIN (SELECT * FROM occurrences WHERE is_definition) o ON o.symbol = h.symbol"))
def j01_defs(spark, d):
    b = Bed(spark, d)
    return code.refs(b.symbols(), b.occurrences(), _name(b), definitions=True)


@query("j02_caller_totals", sql(SYMBOLS, OCCURRENCES, HITS, body="SELECT h.symbol, count(o.file) AS total FROM hits h LEFT JOIN (SELECT * FROM occurrences WHERE NOT is_definition) o ON o.symbol = h.symbol GROUP BY h.symbol"))
def j02_caller_totals(spark, d):
    b = Bed(spark, d)
    return code.nested(code.refs(b.symbols(), b.occurrences(), _name(b)).drop("display_name", "kind"), "symbol").select("symbol", "total")


@query("j03_callees", "WITH " + CALLS + ", hits AS (SELECT s_suppkey AS caller, s_name AS display_name FROM supplier WHERE s_suppkey = 1) SELECT h.caller, display_name, callee FROM hits h LEFT JOIN calls c ON c.caller = h.caller")
def j03_callees(spark, d):
    b = Bed(spark, d)
    suppliers = b.raw("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("display_name"))
    return code.callees(suppliers, b.calls(), suppliers.where("symbol = 1").first().display_name.lower())


@query("j04_impls", sql(SYMBOLS, OCCURRENCES, IMPLS, FIRST, body="SELECT i.impl AS symbol, i.base, s.display_name, s.kind, f.file, f.line FROM impls i JOIN symbols h ON h.symbol = i.base LEFT JOIN symbols s ON s.symbol = i.impl LEFT JOIN firsts f ON f.symbol = i.impl WHERE lower(h.display_name) = lower((SELECT display_name FROM symbols WHERE symbol = (SELECT min(base) FROM impls)))"))
def j04_impls(spark, d):
    b = Bed(spark, d)
    base = b.impls().agg(F.min("base")).first()[0]
    return code.impls(b.symbols(), b.impls(), b.occurrences(), b.symbols().where(F.col("symbol") == base).first().display_name)


@query("j05_tests", sql(SYMBOLS, COVERAGE, HITS, body="SELECT symbol, hit_count, CASE WHEN hit_count > 0 THEN concat('covered (hit count: ', hit_count, ')') ELSE 'not covered' END AS context FROM hits JOIN coverage USING (symbol)"))
def j05_tests(spark, d):
    b = Bed(spark, d)
    return code.tests_of(b.symbols(), b.coverage(), _name(b))


@query("j06_external_symbols", sql("symbols AS (SELECT p_partkey AS symbol, p_name AS display_name, p_type AS kind FROM part WHERE p_partkey % 3 <> 0)", OCCURRENCES, body="SELECT * FROM symbols UNION ALL SELECT symbol, CAST(symbol AS VARCHAR), 'External' FROM (SELECT DISTINCT symbol FROM occurrences) o WHERE symbol NOT IN (SELECT symbol FROM symbols)"))
def j06_external_symbols(spark, d):
    b = Bed(spark, d)
    return code.with_external(b.symbols().where("symbol % 3 <> 0"), b.occurrences())


SCOPES = "scopes AS (SELECT l_suppkey AS file, l_orderkey AS scope, min(l_shipdate_n) AS start, max(l_shipdate_n) + 20 AS stop FROM (SELECT *, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS l_shipdate_n FROM lineitem) GROUP BY 1, 2)"
POINTS = "points AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS id, l_suppkey AS file, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS line, l_orderkey AS symbol, l_linenumber = 1 AS is_definition FROM lineitem)"


@query(
    "j07_enclosing_scope",
    sql(SCOPES, POINTS, body="SELECT p.file, p.line, p.symbol, p.is_definition, m.scope AS containing_symbol FROM points p LEFT JOIN (SELECT id, scope FROM (SELECT p.id, s.scope, row_number() OVER (PARTITION BY p.id ORDER BY s.stop - s.start, s.start, s.scope) AS r FROM points p JOIN scopes s ON s.file = p.file AND p.line BETWEEN s.start AND s.stop AND NOT (p.is_definition AND s.scope = p.symbol)) WHERE r = 1) m ON m.id = p.id"),
)
def j07_enclosing_scope(spark, d):
    li = Bed(spark, d).raw("lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    scopes = li.groupBy(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("scope")).agg(F.min(day).alias("start"), (F.max(day) + 20).alias("stop"))
    points = li.select(F.monotonically_increasing_id().alias("id"), F.col("l_suppkey").alias("file"), day.alias("line"), F.col("l_orderkey").alias("symbol"), (F.col("l_linenumber") == 1).alias("is_definition"))
    return code.enclosing_scope(points, scopes).drop("id")


@query("n01_lead_span", sql(SPANS, body="SELECT file, symbol, line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line, symbol) - 1, line + 500) AS end_line FROM spans"))
def n01_lead_span(spark, d):
    return code.lead_spans(Bed(spark, d).spans())


@query("j08_coverage_overlap", sql(SPANS, RANGES, "led AS (SELECT file, symbol, line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line, symbol) - 1, line + 500) AS end_line FROM spans)", body="SELECT d.symbol, d.file, d.line, d.end_line, CAST(sum(r.count) AS BIGINT) AS hit_count FROM led d JOIN ranges r ON r.file = d.file AND r.count > 0 AND r.line <= d.end_line AND r.end_line >= d.line AND d.end_line >= d.line GROUP BY 1, 2, 3, 4"))
def j08_coverage_overlap(spark, d):
    b = Bed(spark, d)
    return code.coverage_of_spans(b.ranges(), code.lead_spans(b.spans()).where("end_line >= line"))


@query("u06_combined_coverage", sql(COVERAGE, body="SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 1 ELSE hit_count END AS hit_count FROM coverage"))
def u06_combined_coverage(spark, d):
    c = Bed(spark, d).coverage()
    return code.combine_formats(c, c.where("symbol % 2 = 0").withColumn("hit_count", F.lit(1).cast("long")))


@query("n02_occurrence_sequence", sql(OCCURRENCES, body="SELECT symbol, file, line, row_number() OVER (PARTITION BY symbol ORDER BY file, line) - 1 AS seq FROM occurrences"))
def n02_occurrence_sequence(spark, d):
    return git.number_rows(Bed(spark, d).occurrences().select("symbol", "file", "line"), "symbol", "file", "line")


@query("n03_first_definition", sql(OCCURRENCES, FIRST, body="SELECT symbol, file, line FROM firsts"))
def n03_first_definition(spark, d):
    return code.first_definitions(Bed(spark, d).occurrences())


@query("a09_ingest_counts", sql(SYMBOLS, OCCURRENCES, CALLS, IMPLS, body="SELECT (SELECT count(DISTINCT file) FROM occurrences) AS documents, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM occurrences WHERE is_definition) AS definitions, (SELECT count(*) FROM occurrences WHERE NOT is_definition) AS \"references\", (SELECT count(*) FROM calls) AS call_edges, (SELECT count(*) FROM impls) AS impls"))
def a09_ingest_counts(spark, d):
    b = Bed(spark, d)
    return code.ingest_counts(b.symbols(), b.occurrences(), b.calls(), b.impls())


IDS = "ids AS (SELECT concat('scip-php composer app 1 Illuminate/', p_brand, '/', split_part(p_name, ' ', 1), '#', split_part(p_type, ' ', 1), '().') AS symbol, p_partkey FROM part)"


@query("f17_container_filter", sql(IDS, body="SELECT p_partkey, symbol FROM ids WHERE contains(symbol, '/Brand#11#') OR contains(symbol, '/Brand#11/') OR contains(symbol, ' Brand#11#') OR contains(symbol, ' Brand#11/')"))
def f17_container_filter(spark, d):
    p = Bed(spark, d).raw("part")
    word = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    ids = p.select("p_partkey", F.concat(F.lit("scip-php composer app 1 Illuminate/"), "p_brand", F.lit("/"), word("p_name"), F.lit("#"), word("p_type"), F.lit("().")).alias("symbol"))
    return code.in_class(ids, "Brand#11")


@query("c18_method_descriptor", sql(IDS, "d AS (SELECT p_partkey, regexp_extract(symbol, '[^ ]*$') AS d FROM ids)", body="SELECT p_partkey, d AS descriptor, regexp_extract(d, '^([^#]*)#([^(]+)\\(', 1) AS class, regexp_extract(d, '^([^#]*)#([^(]+)\\(', 2) AS method FROM d"))
def c18_method_descriptor(spark, d):
    p = Bed(spark, d).raw("part")
    word = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    ids = p.select("p_partkey", F.concat(F.lit("scip-php composer app 1 Illuminate/"), "p_brand", F.lit("/"), word("p_name"), F.lit("#"), word("p_type"), F.lit("().")).alias("symbol"))
    return ids.select("p_partkey", S.descriptor("symbol").alias("descriptor")).select("p_partkey", "descriptor", S.method_parts("descriptor").alias("m")).select("p_partkey", "descriptor", "m.*")


@query("f18_symbol_kind", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'interface' WHEN 3 THEN 'module' END AS node_type FROM nation")
def f18_symbol_kind(spark, d):
    n = Bed(spark, d).raw("nation")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Method", "Struct", "trait", "Package", "Variable")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return n.select("n_nationkey", P.node_type(kind).alias("node_type"))
