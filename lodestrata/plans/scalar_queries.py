"""Queries of scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import predicates as P
from lodestrata.functions import scalars as S
from lodestrata.plans.registry import query
from lodestrata.plans.testbed import REQUESTS, Bed, sql

NORM = r"regexp_replace(lower(regexp_replace({x}, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')), '[ _]+', '-', 'g')"
SLUG = f"regexp_replace({NORM}, '[^a-z0-9-]', '', 'g')"  # NORM keeps its doubled braces for format()


WRAPPED = "concat(chr(CAST(9 + p_partkey % 5 AS INTEGER)), chr(160), p_name, '_', p_brand, chr(8195), chr(10))"


@query("c01_normalize", f"SELECT p_partkey, {NORM.format(x=WRAPPED)} AS name FROM part")
def c01_normalize(spark, d):
    odd = F.concat(F.chr(F.lit(9) + F.col("p_partkey") % 5), F.lit("\u00a0"), "p_name", F.lit("_"), "p_brand", F.lit("\u2003\n"))
    return Bed(spark, d).raw("part").select("p_partkey", S.normalize(odd).alias("name"))


@query("c02_slugify", f"SELECT c_custkey, {SLUG.format(x='c_name')} AS slug FROM customer")
def c02_slugify(spark, d):
    return Bed(spark, d).raw("customer").select("c_custkey", S.slugify("c_name").alias("slug"))


@query("c03_normalize_relation", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(concat(' ', p_type, ': ', p_brand, '!'), ' ')), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS relation FROM part")
def c03_normalize_relation(spark, d):
    return Bed(spark, d).raw("part").select("p_partkey", S.normalize_relation(F.concat(F.lit(" "), "p_type", F.lit(": "), "p_brand", F.lit("!"))).alias("relation"))


@query("c04_parse_valid_from", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) ELSE TIMESTAMP '2000-01-01 00:00:00' END AS valid_from FROM orders")
def c04_parse_valid_from(spark, d):
    o = Bed(spark, d).raw("orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("2024")
    return o.select("o_orderkey", S.parse_valid_from(text, F.lit("2000-01-01").cast("timestamp")).cast("timestamp_ntz").alias("valid_from"))


@query("c05_clamp", "SELECT event_id, greatest(ts, TIMESTAMP '2024-01-15 00:00:00') AS invalid_at FROM events")
def c05_clamp(spark, d):
    return Bed(spark, d).raw("events").select("event_id", S.clamp_invalid_at("ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("invalid_at"))


@query("c06_normalize_path", "SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') OR (length(s) = 36 AND s[9] = '-' AND s[14] = '-' AND s[19] = '-' AND s[24] = '-') THEN ':id' ELSE s END), '/') AS path FROM pages")
def c06_normalize_path(spark, d):
    return Bed(spark, d).raw("pages").select("page_id", S.normalize_path("url").alias("path"))


@query("c07_tokenize", "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda x: strlen(x) >= 3) AS tokens FROM documents")
def c07_tokenize(spark, d):
    return Bed(spark, d).raw("documents").select("doc_id", S.tokenize("text").alias("tokens"))


FAKE = "concat(text, ' Bearer abcdef1234567890ZZZZ.some-token ghp_', repeat('a', 24), ' sk-', repeat('b', 30), ' end')"


@query("c08_redact", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({FAKE}, '-----BEGIN [A-Z ]+PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]+PRIVATE KEY-----', '[REDACTED]', 'g'), 'Bearer\\s+[A-Za-z0-9._~+/=-]{{10,}}', '[REDACTED]', 'g'), 'ghp_[A-Za-z0-9]{{20,}}', '[REDACTED]', 'g'), 'sk-[A-Za-z0-9_-]{{20,}}', '[REDACTED]', 'g') AS text FROM documents")
def c08_redact(spark, d):
    fake = F.concat(F.col("text"), F.lit(" Bearer abcdef1234567890ZZZZ.some-token ghp_" + "a" * 24 + " sk-" + "b" * 30 + " end"))
    return Bed(spark, d).raw("documents").select("doc_id", S.redact(fake).alias("text"))


@query("c09_stable_id", "SELECT page_id, sha256(url) AS id, substr(sha256(url), 1, 16) AS short_id FROM pages")
def c09_stable_id(spark, d):
    return Bed(spark, d).raw("pages").select("page_id", S.stable_id("url").alias("id"), S.stable_id("url", 16).alias("short_id"))


@query("c11_desc_timestamp", "SELECT event_id, lpad(CAST(9223372036854775807 - event_id AS VARCHAR), 20, '0') AS k FROM events")
def c11_desc_timestamp(spark, d):
    return Bed(spark, d).raw("events").select("event_id", S.desc_timestamp("event_id").alias("k"))


@query("c13_rename", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('src/', p_partkey, '/x.go') WHEN 1 THEN concat('b', p_partkey, '.go') ELSE concat('plain/', p_partkey) END AS path FROM part")
def c13_rename(spark, d):
    k = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("src/{old => "), k, F.lit("}/x.go"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a.go => b"), k, F.lit(".go"))).otherwise(F.concat(F.lit("plain/"), k))
    return Bed(spark, d).raw("part").select("p_partkey", S.collapse_rename(raw).alias("path"))


@query("c14_change_status", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN CAST(l_quantity AS BIGINT) > 0 AND l_linenumber % 2 = 0 THEN 'A' ELSE 'M' END AS status FROM lineitem")
def c14_change_status(spark, d):
    return Bed(spark, d).raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.change_status(F.col("l_quantity").cast("long"), F.col("l_linenumber") % 2).alias("status"))


@query("c16_decode_range", "SELECT l_orderkey, l_partkey, l_linenumber, l_linenumber + 1 AS line, 5 AS \"column\", CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 3 ELSE l_linenumber + 1 END AS end_line, 10 AS end_column FROM lineitem")
def c16_decode_range(spark, d):
    n = F.col("l_linenumber")
    packed = F.when(n % 2 == 0, F.array(n, F.lit(4), n + 2, F.lit(9))).otherwise(F.array(n, F.lit(4), F.lit(9)))
    return Bed(spark, d).raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", S.decode_range(packed).alias("r")).select("l_orderkey", "l_partkey", "l_linenumber", "r.*")


@query("c19_string_ref", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('resources/views/', replace(k, '.', '/'), '.blade.php#') ELSE concat('config/', split_part(k, '.', 1), '.php#', substr(k, length(split_part(k, '.', 1)) + 2)) END AS descriptor FROM (SELECT p_partkey, replace(p_name, ' ', '.') AS k FROM part)")
def c19_string_ref(spark, d):
    kind = F.when(F.col("p_partkey") % 2 == 0, "view").otherwise("config")
    return Bed(spark, d).raw("part").select("p_partkey", S.string_ref(kind, F.replace("p_name", F.lit(" "), F.lit("."))).alias("descriptor"))


@query("c20_enum_values", "SELECT p_partkey, [p_brand, concat('it''', p_size)] AS values FROM part")
def c20_enum_values(spark, d):
    literal = F.concat(F.lit("enum('"), "p_brand", F.lit("','it''"), F.col("p_size").cast("string"), F.lit("')"))
    return Bed(spark, d).raw("part").select("p_partkey", S.enum_values(literal).alias("values"))


@query("c23_table_column", "SELECT p_partkey, p_brand AS \"table\", p_type AS \"column\" FROM part")
def c23_table_column(spark, d):
    return Bed(spark, d).raw("part").select("p_partkey", S.table_column(F.concat("p_brand", F.lit("."), "p_type")).alias("x")).select("p_partkey", "x.*")


@query("c27_ancestors", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN ['/a'] WHEN n_nationkey % 3 = 1 THEN [concat('/a/b/', n_name), '/a/b'] ELSE [concat('/a/b/', n_name, '/c'), concat('/a/b/', n_name), '/a/b'] END AS paths FROM nation")
def c27_ancestors(spark, d):
    k = F.col("n_nationkey") % 3
    path = F.when(k == 0, "/a/").when(k == 1, F.concat(F.lit("/a//b/./"), "n_name", F.lit("/x/.."))).otherwise(F.concat(F.lit("/a/b/"), "n_name", F.lit("/c")))
    return Bed(spark, d).raw("nation").select("n_nationkey", S.ancestors(path).alias("paths"))


@query("f08_request_filter", sql(REQUESTS, body="SELECT * FROM requests WHERE lower(method) = 'click' AND contains(path, '/u/1') AND status_code BETWEEN 200 AND 400"))
def f08_request_filter(spark, d):
    return Bed(spark, d).requests().where(P.request_matches("CLICK", "/u/1", 200, 400))


@query("f14_ephemeral_names", "SELECT c_custkey, c_custkey % 4 = 0 OR (c_custkey % 4 = 1) AS ephemeral FROM customer")
def f14_ephemeral_names(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("/tmp/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("tool-wt-abc"), F.lpad(k.cast("string"), 6, "0"))).otherwise(F.concat(F.lit("Customer "), k.cast("string")))
    return Bed(spark, d).raw("customer").select("c_custkey", P.is_ephemeral(name).alias("ephemeral"))


@query("f15_generic_names", "SELECT c_custkey, c_custkey % 5 < 4 AS generic FROM customer")
def f15_generic_names(spark, d):
    k = F.col("c_custkey")
    t = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("Step "), t)).when(k % 5 == 1, F.concat(t, F.lit(" plan"))).when(k % 5 == 2, F.lit("the Workspace")).when(k % 5 == 3, F.concat(F.lit("apps/"), t)).otherwise(F.concat(F.lit("acme/"), t))
    return Bed(spark, d).raw("customer").select("c_custkey", P.is_generic_name(name).alias("generic"))


@query("f22_transitions", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON concat(a.n_nationkey % 6, b.n_nationkey % 6) IN ('12', '15', '23', '25', '34', '32', '35') AND a.n_regionkey = b.n_regionkey")
def f22_transitions(spark, d):
    from lodestrata.operators.rooms import legal_moves

    n = Bed(spark, d).raw("nation")
    status = lambda c: F.element_at(F.array(*[F.lit(s) for s in ("open", "claimed", "in_progress", "review", "done", "abandoned")]), (F.col(c) % 6 + 1).cast("int"))
    a, b = n.select(F.col("n_nationkey").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("y"), "n_regionkey")
    return legal_moves(a.join(b, "n_regionkey").select("x", "y", status("x").alias("old"), status("y").alias("new"))).select("x", "y")


@query("f23_relevant_changes", "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS relevant FROM part")
def f23_relevant_changes(spark, d):
    k = F.col("p_partkey")
    t = k.cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("src/"), t, F.lit(".go"))).when(k % 4 == 1, F.concat(F.lit("node_modules/"), t, F.lit(".js"))).when(k % 4 == 2, F.concat(F.lit("src/."), t, F.lit(".ts"))).otherwise(F.concat(F.lit("lib/"), t, F.lit(".PY")))
    return Bed(spark, d).raw("part").select("p_partkey", P.relevant_change(path).alias("relevant"))


@query("u01_array_union", "SELECT c_custkey, [c_mktsegment, c_mktsegment, c_name, 'x'] AS names FROM customer")
def u01_array_union(spark, d):
    return Bed(spark, d).raw("customer").select("c_custkey", S.array_union_keep(F.array("c_mktsegment", "c_mktsegment"), F.array("c_name", "c_mktsegment", F.lit("x"), "c_name")).alias("names"))


@query("u03_array_except", "SELECT c_custkey, [c_name] AS gone FROM customer")
def u03_array_except(spark, d):
    return Bed(spark, d).raw("customer").select("c_custkey", F.array_except(F.array("c_name", "c_mktsegment"), F.array(F.col("c_mktsegment"))).alias("gone"))
