"""Index builds: languages, indexer results, freshness, status of all domains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.predicates import SKIP_DIRS, effective_status, is_stale
from lodestrata.plans.storage import checkpointed

MIN_SHARE, PRIMARY_SHARE = 0.01, 0.10
# File extensions by language.
EXTENSIONS = {"typescript": ("ts", "tsx"), "javascript": ("js", "jsx", "mjs", "cjs"), "go": ("go",), "php": ("php",), "python": ("py",)}
# Files at a repository's root that make a language a main one.
MARKERS = {"typescript": ("package.json", "tsconfig.json"), "javascript": ("package.json", "tsconfig.json"), "go": ("go.mod",), "php": ("composer.json",), "python": ("pyproject.toml", "requirements.txt", "setup.py", "Pipfile")}


def language_of(path: Column | str) -> Column:
    """The language of a source file outside dependency folders, or null."""
    p = F.col(path) if isinstance(path, str) else path
    ext = F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    ignored = F.exists(F.split(p, "/"), lambda x: x.isin(*SKIP_DIRS))
    return F.when(~ignored, F.coalesce(*[F.when(ext.isin(*e), k) for k, e in EXTENSIONS.items()]))


def language_shares(counts: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Language, file_count, share and tier; below a share of 0.01 a language is left out.

    counts: language, file_count (a row for each language); markers: language.
    """
    total = F.sum("file_count").over(Window.partitionBy())
    rows = counts.withColumn("share", F.col("file_count") / total).where(F.col("share") >= MIN_SHARE)
    marked = F.lit(False)
    if markers is not None:
        rows = rows.join(markers.select("language", F.lit(True).alias("m")), "language", "left")
        marked = F.coalesce("m", F.lit(False))
    tier = F.when(marked | (F.col("share") >= PRIMARY_SHARE), "primary").otherwise("incidental")
    return rows.select("language", "file_count", "share", tier.alias("tier")).orderBy(F.desc("file_count"), "language")


def fold_indexers(shares: DataFrame, indexer: Column | None = None) -> DataFrame:
    """Languages that one indexer covers, added up; the stronger tier, tested again on the sum."""
    which = indexer if indexer is not None else F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))
    rows = shares.groupBy(which.alias("indexer")).agg(F.sum("file_count").alias("file_count"), F.sum("share").alias("share"), F.bool_or(F.col("tier") == "primary").alias("p"))
    return rows.select("indexer", "file_count", "share", F.when(F.col("p") | (F.col("share") >= PRIMARY_SHARE), "primary").otherwise("incidental").alias("tier"))


def repo_status(manifests: DataFrame) -> DataFrame:
    """The one label for each repository.

    manifests: repo, status, head, indexed_head, newest, indexed_at, total_symbols,
    indexers array<struct<language, tier, status, symbol_count, file_count>>.
    """
    unrecorded = (F.col("total_symbols") > 0) & ~F.exists("indexers", lambda r: r["symbol_count"] > 0)
    hollow = F.exists("indexers", lambda r: (r["tier"] == "primary") & (r["status"] == "ok") & (r["symbol_count"] == 0) & (r["file_count"] > 0))
    failed = F.exists("indexers", lambda r: (r["tier"] == "primary") & r["status"].isin("missing", "failed"))
    recorded = F.coalesce("status", F.when(failed, "partial").otherwise("ready"))
    return manifests.select("repo", effective_status(recorded, ~unrecorded & hollow, is_stale("head", "indexed_head", "newest", "indexed_at")).alias("status"))


def indexer_impact(missing: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each missing tool (language) the number of repositories whose main language needs it."""
    uses = manifests.select("repo", F.explode("indexers").alias("i")).where("i.tier = 'primary'").select("repo", F.col("i.language").alias("language")).distinct()
    return missing.join(uses, "language", "left").groupBy("language").agg(F.count("repo").alias("repos"))


def change_state(files: DataFrame, cursors: DataFrame, now: Column, active: str = "5 minutes") -> DataFrame:
    """Active, new, grown, truncated or unchanged, and the byte to read from.

    files: path, size, mod_time; cursors: path, processed_bytes, mod_time.
    """
    c = cursors.select("path", F.col("processed_bytes").alias("done"), F.col("mod_time").alias("seen"))
    rows = files.join(c, "path", "left")
    state = (
        F.when(F.col("mod_time") > now - F.expr(f"interval {active}"), "active")
        .when(F.col("done").isNull(), "new")
        .when(F.col("size") > F.col("done"), "grown")
        .when((F.col("size") < F.col("done")) & (F.col("mod_time") != F.col("seen")), "truncated")
        .otherwise("unchanged")
    )
    return rows.select("path", "size", "mod_time", state.alias("state"), F.when(state == "grown", F.col("done")).when(state.isin("new", "truncated"), F.lit(0)).alias("read_from"))


def batches(rows: DataFrame, size: int = 1000, *order: str) -> DataFrame:
    """Rows in numbered batches.

    Rows are sorted by ranges and written once with the number of their range; places
    within each range and the ranges' sizes come from that table alone, as another sort
    could cut the ranges elsewhere.
    """
    spark = rows.sparkSession
    ranged = rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = checkpointed(ranged)
    sizes = sorted(held.groupBy("__part").count().collect())  # a row for each range
    base, at = [], 0
    for part, n in sizes:
        base.append((part, at))
        at += n
    bases = spark.createDataFrame(base, "__part int, __base long")
    batch = F.floor((F.col("__base") + F.col("__place")) / size)
    return held.join(F.broadcast(bases), "__part").withColumn("batch", batch).drop("__part", "__place", "__base")


def roll_up(results: DataFrame) -> DataFrame:
    """Totals over per-file results (path, state, episodes, error)."""
    return results.agg(F.count("*").alias("files"), F.count_if(F.col("state").isin("new", "grown", "truncated")).alias("ingested"), F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "unchanged").alias("unchanged"), F.coalesce(F.sum("episodes"), F.lit(0)).alias("episodes"), F.count("error").alias("errors"))


def newest_source(files: DataFrame) -> DataFrame:
    """The newest change of a source file (path, mod_time)."""
    return files.where(language_of("path").isNotNull()).agg(F.max("mod_time").alias("newest"))


def languages(files: DataFrame) -> DataFrame:
    """Language and number of source files (path)."""
    return files.select(language_of("path").alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("file_count"))


def nearest_index(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """For each path the deepest indexed repository (repo) above it, or null."""
    from lodestrata.functions.scalars import ancestors

    up = paths.select("path", F.explode(ancestors("path", 1)).alias("repo")).join(repos.select("repo").distinct(), "repo")
    best = up.groupBy("path").agg(F.max_by("repo", F.length("repo")).alias("repo"))
    return paths.join(best, "path", "left")


def counts(**tables: DataFrame) -> DataFrame:
    """The number of rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def domain_counts(statuses: DataFrame) -> DataFrame:
    """For each domain the number of repositories of each label (domain, status)."""
    return statuses.groupBy("domain").agg(F.count("*").alias("repos"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "stale", "empty", "partial")])


def indexer_results(repos: DataFrame, runner: Callable[[str, str], str], need: str = "primary") -> DataFrame:
    """Run an indexer given from outside for each repository and language (repo, language, tier, file_count).

    runner: (language, repo) -> path of the index, or an exception; what it raises is
    the row's error.  Languages of another tier than ``need`` are skipped.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                if r.tier != need:
                    out.append((r.repo, r.language, "skipped", None, None))
                    continue
                try:
                    out.append((r.repo, r.language, "ok", runner(r.language, r.repo), None))
                except FileNotFoundError as e:
                    out.append((r.repo, r.language, "missing", None, str(e)))
                except Exception as e:
                    out.append((r.repo, r.language, "failed", None, str(e)))
            yield pd.DataFrame(out, columns=["repo", "language", "status", "index", "error"])

    return repos.select("repo", "language", "tier").mapInPandas(run, "repo string, language string, status string, index string, error string")
