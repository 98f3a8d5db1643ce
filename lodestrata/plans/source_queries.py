"""Queries over the sources: driver rows are put into each format and read back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import builds
from lodestrata.plans.registry import query
from lodestrata.plans.storage import shared_root
from lodestrata.plans.testbed import BLAME, CHANGES, COMMITS, MESSAGES, OCCURRENCES, RANGES, Bed, sql
from lodestrata.sources import coverage, git, php, scip, transcripts


#: Statements in one report, about 4 MB of JSON.
STATEMENTS = 50_000


def _text_files(df: DataFrame, name: str) -> str:
    """A shared folder with the lines of df (value)."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.select("value").write.text(path)
    return path


def _whole_files(df: DataFrame, name: str, **options: str) -> str:
    """A shared folder with a file for each row of df (g, value)."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.select("value", "g").repartition("g").write.partitionBy("g").text(path, **options)
    return path


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("s18_gocover", sql(RANGES, body="SELECT concat('f', file, '.go') AS file, line, end_line, count FROM ranges"))
def s18_gocover(spark: SparkSession, d: str) -> DataFrame:
    r = Bed(spark, d).ranges()
    line = _text("example.com/app/f", F.col("file"), ".go:", F.col("line"), ".1,", F.col("end_line"), ".9 1 ", F.col("count"))
    return coverage.gocover(spark, _text_files(r.select(line.alias("value")), "gocover"), module="example.com/app")


@query("s19_istanbul", sql(RANGES, body="SELECT concat('f', file, '.ts') AS file, line, end_line, count FROM ranges"))
def s19_istanbul(spark: SparkSession, d: str) -> DataFrame:
    ranges = Bed(spark, d).ranges()
    n = F.row_number().over(Window.partitionBy("file").orderBy("line", "end_line", "count"))
    # a report holds about STATEMENTS at most, so there are more reports for more rows; a file of more statements lies in several
    r = ranges.withColumn("n", n).withColumn("part", F.floor(F.col("n") / STATEMENTS)).withColumn("path", _text("/r/f", F.col("file"), ".ts"))
    place = lambda c: F.struct(F.col(c).cast("int").alias("line"), F.lit(0).alias("column"))
    told = F.collect_list(F.struct(F.col("n").cast("string").alias("n"), F.struct(place("line").alias("start"), place("end_line").alias("end")).alias("place"), "count"))
    pairs = lambda c: F.map_from_entries(F.transform("told", lambda x: F.struct(x["n"], x[c])))
    files = r.groupBy("file", "path", "part").agg(told.alias("told")).select("file", "path", "part", pairs("place").alias("statementMap"), pairs("count").alias("s"))
    # as text before they meet in a report: {"path": {...}} without its braces
    entry = F.to_json(F.create_map("path", F.struct("path", "statementMap", "s")))
    reports = max(8, -(-ranges.count() // STATEMENTS))
    texts = files.select(F.pmod(F.xxhash64("file", "part"), F.lit(reports)).alias("g"), F.substring(entry, F.lit(2), F.length(entry) - 2).alias("entry"))
    whole = texts.groupBy("g").agg(_text("{", F.array_join(F.collect_list("entry"), ","), "}").alias("value"))
    return coverage.istanbul(spark, _whole_files(whole, "istanbul", compression="gzip"), root="/r")


@query("s20_clover", sql(RANGES, body="SELECT concat('f', file, '.php') AS file, line, line AS end_line, count FROM ranges"))
def s20_clover(spark: SparkSession, d: str) -> DataFrame:
    line = _text('<line num="', F.col("line"), '" type="stmt" count="', F.col("count"), '"/>')
    files = Bed(spark, d).ranges().groupBy("file").agg(F.array_join(F.collect_list(line), "").alias("lines"))
    element = _text('<file path="/r/f', F.col("file"), '.php">', F.col("lines"), "</file>")
    reports = files.groupBy((F.col("file") % 8).alias("g")).agg(_text("<coverage><project>", F.array_join(F.collect_list(element), ""), "</project></coverage>").alias("value"))
    return coverage.clover(spark, _whole_files(reports, "clover"), root="/r")


@query("s21_pycov", sql(RANGES, body="SELECT DISTINCT concat('f', file, '.py') AS file, line, line AS end_line, 1 AS count FROM ranges"))
def s21_pycov(spark: SparkSession, d: str) -> DataFrame:
    files = Bed(spark, d).ranges().groupBy("file").agg(F.collect_set(F.col("line").cast("int")).alias("executed_lines"))
    entry = F.struct(_text("f", F.col("file"), ".py").alias("path"), F.struct("executed_lines"))
    whole = files.groupBy((F.col("file") % 8).alias("g")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("files"))).alias("value"))
    return coverage.pycov(spark, _whole_files(whole, "pycov"))


LOGGED = "logged AS (SELECT hash, path, added, removed % 2 AS removed FROM changes)"


@query(
    "s13_commit_log",
    sql(COMMITS, CHANGES, LOGGED, body="SELECT CAST(hash AS VARCHAR) AS hash, author, CAST(epoch(date) AS BIGINT) AS date, message, CAST(path AS VARCHAR) AS path, added, removed, CASE WHEN added > 0 AND removed = 0 THEN 'A' ELSE 'M' END AS status FROM commits JOIN logged USING (hash)"),
)
def s13_commit_log(spark: SparkSession, d: str) -> DataFrame:
    b = Bed(spark, d)
    stat = _text(F.col("added"), "\t", F.col("removed") % 2, "\t", F.col("path"))
    stats = b.changes().groupBy("hash").agg(F.array_join(F.collect_list(stat), "\n").alias("stats"))
    c = b.commits().join(stats, "hash")
    head = F.concat_ws(git.FIELD, F.col("hash").cast("string"), "author", F.col("email").cast("string"), F.unix_timestamp(F.col("date").cast("timestamp")).cast("string"), "message", F.concat(F.lit("\n"), "stats"))
    log = git.parse_log(c.select(F.concat(F.lit(git.RECORD), head).alias("value")))
    return log.select("hash", "author", "date", "message", F.explode("files").alias("f")).select("hash", "author", "date", "message", "f.*")


@query("s14_blame", sql(BLAME, body="SELECT CAST(path AS VARCHAR) AS path, line, format('{:040x}', commit) AS commit, concat('author ', commit) AS author, commit AS date FROM blame"))
def s14_blame(spark: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("path", "commit").orderBy("line")) == 1
    name = F.lower(F.lpad(F.hex("commit"), 40, "0"))
    told = _text("author author ", F.col("commit"), "\nauthor-mail <a@b>\nauthor-time ", F.col("commit"), "\nsummary s\n")
    lines = Bed(spark, d).blame().select("path", "line", _text(name, " 1 ", F.col("line"), "\n", F.when(first, told).otherwise(""), "\tx\n").alias("t"))
    texts = lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "").alias("porcelain"))
    return git.blame_rows(texts.select(F.col("path").cast("string").alias("path"), "porcelain")).select("path", "line", "commit", "author", "date")


@query("s16_symbol_index", sql(OCCURRENCES, body="SELECT CAST(symbol AS VARCHAR) AS symbol, CAST(file AS VARCHAR) AS file, line, 1 AS \"column\", line AS end_line, 6 AS end_column, is_definition FROM occurrences"))
def s16_symbol_index(spark: SparkSession, d: str) -> DataFrame:
    o = Bed(spark, d).occurrences()
    packed = F.array((F.col("line") - 1).cast("int"), F.lit(0), F.lit(5))
    one = F.struct(F.col("symbol").cast("string").alias("symbol"), packed.alias("range"), F.col("is_definition").cast("int").alias("roles"))
    docs = o.groupBy(F.col("file").cast("string").alias("file")).agg(F.collect_list(one).alias("occurrences"))
    return scip.occurrences(scip.decoded(scip.encoded(docs))).drop("scope_start", "scope_stop")


TURNS = "turns AS (SELECT CAST(room_id AS VARCHAR) AS path, seq, sender AS role, trim(body, ' ') AS text FROM messages WHERE sender IN ('user', 'assistant') AND trim(body, ' ') <> '' AND body NOT LIKE '[%')"


def _lines(b: Bed, line: F.Column) -> DataFrame:
    m = b.messages().where("body not like '[%'")
    return m.select(F.col("room_id").cast("string").alias("path"), F.col("seq").cast("long").alias("start"), (F.col("seq") + 1).cast("long").alias("stop"), line.alias("line"))


def _session(b: Bed) -> DataFrame:
    message = F.struct(F.col("sender").alias("role"), F.col("body").alias("content"))
    return transcripts.session_turns(_lines(b, F.to_json(F.struct(F.col("sender").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("/r").alias("cwd"), message.alias("message")))))


@query("s26_session_turns", sql(MESSAGES, TURNS, body="SELECT path, seq AS start, role, text FROM turns"))
def s26_session_turns(spark: SparkSession, d: str) -> DataFrame:
    return _session(Bed(spark, d)).select("path", "start", "role", "text")


@query("s27_rollout_turns", sql(MESSAGES, TURNS, body="SELECT path, seq AS start, role, text FROM turns"))
def s27_rollout_turns(spark: SparkSession, d: str) -> DataFrame:
    content = F.array(F.struct(F.lit("input_text").alias("type"), F.col("body").alias("text")))
    payload = F.struct(F.lit("message").alias("type"), F.col("sender").alias("role"), content.alias("content"))
    line = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("response_item").alias("type"), payload.alias("payload")))
    return transcripts.rollout_turns(_lines(Bed(spark, d), line)).select("path", "start", "role", "text")


@query(
    "n06_episodes",
    sql(MESSAGES, TURNS, body="SELECT path, string_agg(concat(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END, ': ', text, chr(10), chr(10)), '' ORDER BY seq) AS text FROM turns GROUP BY path HAVING count(*) >= 3"),
)
def n06_episodes(spark: SparkSession, d: str) -> DataFrame:
    """One episode for each session, as the limit is beyond all of them; the cuts have worked cases in the tests."""
    made = transcripts.episodes(_session(Bed(spark, d)), "sessions", limit=1 << 30)
    return made.select(F.split_part("source_ref", F.lit("#"), F.lit(1)).alias("path"), "text")


PHP = "<?php\nuse App\\Models\\P{k};\n// P{k}::class\n$a = P{k}::class;\necho view('v.{k}'), config('c.{k}.x');\n"


def _php(b: Bed) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return b.raw("part").select(_text("routes/", k, ".php").alias("file"), F.replace(F.lit(PHP), F.lit("{k}"), k).alias("text"))


REFS = """refs AS (SELECT concat('routes/', p_partkey, '.php') AS file, kind, line, CASE kind WHEN 'class' THEN concat('App\\Models\\P', p_partkey) WHEN 'view' THEN concat('v.', p_partkey) ELSE concat('c.', p_partkey, '.x') END AS name, p_partkey
FROM part, (VALUES ('class', 4), ('view', 5), ('config', 5)) v(kind, line))"""


@query("s33_php_references", sql(REFS, body="SELECT file, kind, line, name FROM refs"))
def s33_php_references(spark: SparkSession, d: str) -> DataFrame:
    return php.references(_php(Bed(spark, d)))


@query("s34_framework_files", sql(REFS, body="SELECT file, kind, line, name FROM refs WHERE p_partkey % 3 <> 0"))
def s34_framework_files(spark: SparkSession, d: str) -> DataFrame:
    files = _php(Bed(spark, d))
    k = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    return php.framework_references(files.withColumn("file", F.when(k % 3 == 0, F.concat(F.lit("app/"), "file")).otherwise(F.col("file"))))


@query(
    "j13_bound_references",
    sql(
        REFS,
        body="SELECT file, line, kind, name, CASE WHEN kind = 'class' AND p_partkey % 2 = 0 THEN concat('scip-php composer acme/app 1 App/Models/P', p_partkey, '#') WHEN kind = 'class' THEN concat('scip-php composer local/app 0 App/Models/P', p_partkey, '#') WHEN kind = 'view' THEN concat('scip-php composer local/app 0 resources/views/v/', p_partkey, '.blade.php#') ELSE concat('scip-php composer local/app 0 config/c.php#', p_partkey, '.x') END AS symbol, NOT (kind = 'class' AND p_partkey % 2 = 0) AS made_up FROM refs",
    ),
)
def j13_bound_references(spark: SparkSession, d: str) -> DataFrame:
    b = Bed(spark, d)
    known = b.raw("part").where("p_partkey % 2 = 0").select(_text("scip-php composer acme/app 1 App/Models/P", F.col("p_partkey"), "#").alias("symbol"))
    return php.bind(php.references(_php(b)), known)


@query(
    "j14_facade_references",
    "SELECT l_orderkey AS file, l_linenumber AS line, concat('scip-php composer laravel/framework 1 Illuminate/Database/', c, '#m', l_partkey % 5, '().') AS symbol FROM lineitem, (VALUES ('DatabaseManager'), ('Connection')) v(c)",
)
def j14_facade_references(spark: SparkSession, d: str) -> DataFrame:
    rows = Bed(spark, d).raw("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), _text("scip-php composer laravel/framework 1 Illuminate/Support/Facades/DB#m", F.col("l_partkey") % 5, "().").alias("symbol"), F.lit(False).alias("is_definition"))
    return php.facade_refs(rows, rows.select("symbol").limit(0)).drop("facade_symbol")


@query(
    "s31_languages",
    "SELECT CASE p_size % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' ELSE 'php' END AS language, count(*) AS file_count FROM part WHERE p_size % 5 <> 4 GROUP BY 1",
)
def s31_languages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 5
    ending = F.when(n == 0, "x.go").when(n == 1, "x.TSX").when(n == 2, "x.py").when(n == 3, "x.php").otherwise("vendor/x.php")
    return builds.languages(Bed(spark, d).raw("part").select(_text("src/", F.col("p_partkey"), "/", ending).alias("path")))


@query("a20_newest_source", "SELECT max(o_orderdate) AS newest FROM orders WHERE o_orderkey % 3 <> 0")
def a20_newest_source(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 3 == 0, "README.md").otherwise("main.go")
    return builds.newest_source(Bed(spark, d).raw("orders").select(name.alias("path"), F.col("o_orderdate").alias("mod_time")))


@query("s29_seed_notes", "SELECT concat(n_name, chr(10), chr(10), 'Body of ', n_nationkey) AS text FROM nation")
def s29_seed_notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    notes = Bed(spark, d).raw("nation").select(k.alias("g"), _text("---\nname: x\ndescription: \"", F.col("n_name"), "\"\n---\nBody of ", k, "\n").alias("value"))
    return transcripts.seed_notes(spark, _whole_files(notes, "notes")).select("text")


@query("s28_run_folders", "SELECT concat('Run run-', n_nationkey, ' (done)', chr(10), 'Iteration 1: ', n_name, ' FAIL', chr(10), 'again', chr(10), 'Iteration 2: plan PASS') AS text FROM nation")
def s28_run_folders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    it = lambda n, plan, summary, passed, feedback: F.struct(F.lit(n).alias("n"), plan.alias("plan"), summary.alias("summary"), F.lit(passed).alias("passed"), F.lit(feedback).alias("feedback"))
    none = F.lit(None).cast("string")
    iters = F.array(it(1, none, F.col("n_name"), False, "again"), it(2, F.lit("plan"), none, True, ""))
    runs = Bed(spark, d).raw("nation").select(k.alias("g"), F.to_json(F.struct(_text("run-", k).alias("name"), F.lit("done").alias("status"), iters.alias("iters"))).alias("value"))
    return transcripts.run_folders(spark, _whole_files(runs, "runs")).select("text")
