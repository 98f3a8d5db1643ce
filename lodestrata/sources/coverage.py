"""Coverage reports as covered ranges: file, line, end_line, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalars import relative_path

RANGE = ("file", "line", "end_line", "count")
READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    """Register a report format; a name can be taken once."""

    def keep(f):
        if name in READERS:
            raise ValueError(f"format {name} is registered already")
        READERS[name] = f
        return f

    return keep


def ranges(df: DataFrame, file, line, end_line, count) -> DataFrame:
    return df.select(file.alias("file"), line.cast("long").alias("line"), end_line.cast("long").alias("end_line"), count.cast("long").alias("count"))


@reader("gocover")
def gocover(spark: SparkSession, path: str, root: str = "", module: str = "") -> DataFrame:
    """``module/file.go:line.col,line.col statements count``."""
    p = r"^(.*):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$"
    rows = spark.read.text(path).where(F.col("value").rlike(p))
    part = lambda i: F.regexp_extract("value", p, i)
    return ranges(rows, relative_path(part(1), module) if module else part(1), part(2), part(3), part(4))


@reader("istanbul")
def istanbul(spark: SparkSession, path: str, root: str = "", module: str = "") -> DataFrame:
    """One JSON object of files with a statement map and counts."""
    place = "struct<line:int,column:int>"
    kind = f"map<string,struct<path:string,statementMap:map<string,struct<start:{place},end:{place}>>,s:map<string,long>>>"
    files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "f"))
    rows = files.select(F.coalesce("f.path", "key").alias("path"), F.col("f.s").alias("s"), F.explode("f.statementMap").alias("id", "m"))
    return ranges(rows, relative_path("path", root) if root else F.col("path"), F.col("m.start.line"), F.col("m.end.line"), F.coalesce(F.try_element_at("s", "id"), F.lit(0)))


@reader("clover")
def clover(spark: SparkSession, path: str, root: str = "", module: str = "") -> DataFrame:
    """The stmt and method lines of every file element."""
    schema = "_name string, _path string, line array<struct<_num:int,_type:string,_count:long>>"
    files = spark.read.schema(schema).xml(path, rowTag="file")
    rows = files.select(F.coalesce("_path", "_name").alias("path"), F.explode("line").alias("l")).where(F.col("l._type").isin("stmt", "method"))
    return ranges(rows, relative_path("path", root) if root else F.col("path"), F.col("l._num"), F.col("l._num"), F.col("l._count"))


@reader("pycov")
def pycov(spark: SparkSession, path: str, root: str = "", module: str = "") -> DataFrame:
    """The executed lines of every file, once each."""
    kind = "struct<files:map<string,struct<executed_lines:array<int>>>>"
    files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["files"]).alias("path", "f"))
    rows = files.select("path", F.explode("f.executed_lines").alias("n"))
    return ranges(rows, relative_path("path", root) if root else F.col("path"), F.col("n"), F.col("n"), F.lit(1))


def first_reports(listing: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of the files listed (path) the first by priority for each format; patterns: format, name, priority."""
    met = listing.join(F.broadcast(patterns), F.col("path").endswith(F.col("name")))  # a row for each known report name
    return met.groupBy("format").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
