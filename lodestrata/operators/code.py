"""Code symbols: references, definitions, callers, callees, implementations, scopes, coverage.

symbols: symbol, display_name, kind; occurrences: symbol, file, line, column,
end_line, end_column, containing_symbol, is_definition; call_edges: caller, callee;
impl_edges: base, impl.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.predicates import in_container, name_is
from lodestrata.functions.scalars import coverage_context, descriptor

#: Lines in one bucket of the interval joins.
BUCKET = 64
LAST_SPAN = 500


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    """all symbols of a name, whatever its case."""
    return symbols.where(name_is("display_name", name))


def refs(symbols: DataFrame, occurrences: DataFrame, name: str, definitions: bool = False) -> DataFrame:
    """Occurrences of each symbol of a name; a symbol without any stays with nulls."""
    hits = by_name(symbols, name).select("symbol", "display_name", "kind")
    return hits.join(occurrences.where(F.col("is_definition") == definitions), "symbol", "left")


def nested(flat: DataFrame, *keys: str) -> DataFrame:
    """The nested form of a flat result: a list of rows for each key and their number."""
    rest = [c for c in flat.columns if c not in keys]
    return flat.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col(rest[0]).isNotNull(), F.struct(*rest)))).alias("occurrences"), F.count(rest[0]).alias("total"))


def callees(symbols: DataFrame, call_edges: DataFrame, name: str) -> DataFrame:
    """What the symbols of a name call."""
    hits = by_name(symbols, name).select(F.col("symbol").alias("caller"), "display_name")
    return hits.join(call_edges, "caller", "left")


def first_definitions(occurrences: DataFrame) -> DataFrame:
    """Each symbol's first definition by place."""
    place = F.struct("file", "line")
    defs = occurrences.where("is_definition").groupBy("symbol").agg(F.min(place).alias("p"))
    return defs.select("symbol", "p.file", "p.line")


def impls(symbols: DataFrame, impl_edges: DataFrame, occurrences: DataFrame, name: str) -> DataFrame:
    """Implementations of a base symbol, each with its first definition if known."""
    hits = by_name(symbols, name).select(F.col("symbol").alias("base"))
    found = hits.join(impl_edges, "base").select("base", F.col("impl").alias("symbol"))
    return found.join(symbols.select("symbol", "display_name", "kind"), "symbol", "left").join(first_definitions(occurrences), "symbol", "left")


def tests_of(symbols: DataFrame, coverage: DataFrame, name: str) -> DataFrame:
    """Coverage of the symbols of a name, with a line of text."""
    return by_name(symbols, name).select("symbol").join(coverage, "symbol").withColumn("context", coverage_context("hit_count"))


def with_external(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Symbols, and a row of kind External for each one that only occurrences know."""
    unknown = occurrences.select("symbol").distinct().join(symbols.select("symbol"), "symbol", "left_anti")
    return symbols.select("symbol", "display_name", "kind").unionByName(unknown.select("symbol", descriptor(F.col("symbol").cast("string")).alias("display_name"), F.lit("External").alias("kind")))


def enclosing_scope(occurrences: DataFrame, scopes: DataFrame) -> DataFrame:
    """For each occurrence (id, file, line, symbol, is_definition) the smallest scope (file, scope, start, stop) around its line; a definition is not its own scope.

    Scopes are cut into buckets of lines, so that the join is on equal keys.
    """
    cut = scopes.withColumn("bucket", F.explode(F.sequence((F.col("start") / BUCKET).cast("long"), (F.col("stop") / BUCKET).cast("long"))))
    at = occurrences.withColumn("bucket", (F.col("line") / BUCKET).cast("long"))
    met = at.join(cut, ["file", "bucket"]).where((F.col("line") >= F.col("start")) & (F.col("line") <= F.col("stop")) & ~(F.col("is_definition") & (F.col("scope") == F.col("symbol"))))
    best = met.groupBy("id").agg(F.min_by("scope", F.struct(F.col("stop") - F.col("start"), "start", "scope")).alias("containing_symbol"))
    return occurrences.join(best, "id", "left")


def lead_spans(defs: DataFrame, last: int = LAST_SPAN) -> DataFrame:
    """One-line spans (file, symbol, line, end_line) go on to the line before the next definition, the last one ``last`` lines on."""
    following = F.lead("line").over(Window.partitionBy("file").orderBy("line", "symbol"))
    return defs.withColumn("end_line", F.when(F.col("end_line") <= F.col("line"), F.coalesce(following - 1, F.col("line") + last)).otherwise(F.col("end_line")))


def coverage_of_spans(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits of each definition: the counts of all covered ranges of its file that overlap it.

    Both sides are cut into buckets of lines; a pair is counted in the first bucket
    that it shares.
    """
    buckets = lambda a, b: F.explode(F.sequence((F.col(a) / BUCKET).cast("long"), (F.col(b) / BUCKET).cast("long")))
    r = ranges.where("count > 0").select("file", F.col("line").alias("a"), F.col("end_line").alias("b"), "count").withColumn("bucket", buckets("a", "b"))
    d = spans.select("file", "symbol", "line", "end_line").withColumn("bucket", buckets("line", "end_line"))
    first = F.greatest((F.col("a") / BUCKET).cast("long"), (F.col("line") / BUCKET).cast("long"))
    met = r.join(d, ["file", "bucket"]).where((F.col("a") <= F.col("end_line")) & (F.col("b") >= F.col("line")) & (F.col("bucket") == first))
    return met.groupBy("symbol", "file", "line", "end_line").agg(F.sum("count").alias("hit_count"))


def combine_formats(*by_priority: DataFrame) -> DataFrame:
    """Coverage of several formats; a symbol has the record of the last format that has it."""
    out = None
    for k, df in enumerate(by_priority):
        part = df.withColumn("__p", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in by_priority[0].columns if c != "symbol"]), "__p").alias("r")).select("symbol", "r.*")


def in_class(flat: DataFrame, container: str) -> DataFrame:
    """result rows whose symbol id has the container as a segment."""
    return flat.where(in_container("symbol", container))


def ingest_counts(symbols: DataFrame, occurrences: DataFrame, call_edges: DataFrame, impl_edges: DataFrame) -> DataFrame:
    """One row of totals."""
    n = lambda df, name, cond=None: df.agg((F.count_if(cond) if cond is not None else F.count("*")).alias(name))
    occ = occurrences.agg(F.count_distinct("file").alias("documents"), F.count_if("is_definition").alias("definitions"), F.count_if(~F.col("is_definition")).alias("references"))
    tall = n(symbols, "v").withColumn("k", F.lit("symbols"))
    for df, k in ((call_edges, "call_edges"), (impl_edges, "impls")):
        tall = tall.unionByName(n(df, "v").withColumn("k", F.lit(k)))
    tall = tall.unionByName(occ.unpivot([], ["documents", "definitions", "references"], "k", "v"))
    return tall.groupBy().pivot("k", ["documents", "symbols", "definitions", "references", "call_edges", "impls"]).agg(F.first("v"))
