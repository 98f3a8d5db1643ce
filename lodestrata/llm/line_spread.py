"""Line deduplication by the number of distinct sites that carry a line.

Every line of every document is hashed (white space at its ends doesn't count;
blank lines are left alone).  For each hash, HyperLogLog sketches of the sites are
merged by aggregation.  Lines whose estimate lies so near ``min_sites`` that the
sketch's error could decide get an exact distinct count.  A line that at least
``min_sites`` sites carry is boilerplate: it stays once, where it stands first in
the document with the smallest doc_id, so that nothing vanishes altogether, and goes
everywhere else.

A null site is no site; a null text stays null.  Copies of a document on many sites
so keep one whole document.  Rows that share the smallest doc_id each keep the line.

All of it is DataFrame functions: each document gets the boilerplate that it holds by
a join on doc_id, and is cut and joined again where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import written

MIN_SITES, LG_K, SIGMAS = 10, 10, 4.0
#: Boilerplate lines that are broadcast (some 50 bytes each in memory); more of them are joined by a shuffle.
MOST_BROADCAST = 200_000


def _lines(docs: DataFrame, site: str) -> DataFrame:
    line = F.trim(F.col("line"))
    return docs.select("doc_id", F.col(site).alias("site"), F.explode(F.split("text", "\n")).alias("line")).where(line != "").select("doc_id", "site", F.xxhash64(line).alias("key"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """key and first_doc of the lines that min_sites distinct sites carry."""
    lines = _lines(docs, site)
    error = SIGMAS * 1.04 / 2 ** (LG_K / 2)
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("first_doc"))
    wide = written(spread.select("key", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= int(min_sites * (1 - error))), "line-spread")
    near = wide.where(F.col("sites") <= min_sites * (1 + error))
    sure = wide.where(F.col("sites") > min_sites * (1 + error))
    keys = near.select("key")
    if keys.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    exact = lines.join(keys, "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("key")
    return written(sure.select("key", "first_doc").unionByName(near.join(exact, "key", "left_semi").select("key", "first_doc")), "boilerplate")


def _gone(key: Column, i: Column, keys: Column, bad: Column, own: Column) -> Column:
    """Does the line at place i go: boilerplate of another document, or this one's own once more?"""
    again = F.array_contains(own, key) & (F.array_position(keys, key) <= i)
    return F.coalesce(F.array_contains(bad, key) | again, F.lit(False))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """docs with text cleaned, and n_lines and n_removed beside its own columns.

    Columns of docs with these two names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    found = boilerplate(docs, min_sites, site)
    told = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    held = _lines(docs, site).join(told, "key").groupBy(F.col("doc_id").alias("__doc"))
    per_doc = held.agg(
        F.collect_set(F.when(F.col("first_doc").eqNullSafe(F.col("doc_id")), F.col("key"))).alias("__own"),
        F.collect_set(F.when(~F.col("first_doc").eqNullSafe(F.col("doc_id")), F.col("key"))).alias("__bad"),
    )
    none = F.array().cast("array<bigint>")
    lines = F.split("text", "\n")
    both = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc")
    both = both.withColumns({"__own": F.coalesce("__own", none), "__bad": F.coalesce("__bad", none), "__lines": F.when(F.col("text").isNotNull(), lines)})
    hit = F.size("__own") + F.size("__bad") > 0
    keyed = F.transform("__lines", lambda x: F.struct(x.alias("x"), F.xxhash64(F.trim(x)).alias("k")))
    both = both.withColumn("__keyed", F.when(hit, keyed))
    keys = F.when(F.size("__own") > 0, F.transform("__keyed", lambda x: x["k"])).otherwise(none)
    both = both.withColumn("__keys", keys)
    left = F.filter("__keyed", lambda x, i: ~_gone(x["k"], i, F.col("__keys"), F.col("__bad"), F.col("__own")))
    both = both.withColumn("__left", left)
    gone = F.when(F.col("__left").isNull(), F.lit(0)).otherwise(F.size("__keyed") - F.size("__left"))
    text = F.when(gone > 0, F.array_join(F.transform("__left", lambda x: x["x"]), "\n")).otherwise(F.col("text"))
    return both.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter("__lines", lambda x: F.trim(x) != ""))).cast("long").alias("n_lines"),
        gone.cast("long").alias("n_removed"),
    )


#: The same in DuckDB SQL: exact counts for every line.
ORACLE_SQL = f"""
WITH pieces AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, source, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM pieces),
keyed AS (SELECT *, trim(line, ' ') AS k, row_number() OVER (PARTITION BY doc_id, trim(line, ' ') ORDER BY pos) AS nth FROM lines),
wide AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT y.doc_id, y.line, y.pos, y.k, w.k IS NOT NULL AND NOT (w.first_doc = y.doc_id AND y.nth = 1) AS gone FROM keyed y LEFT JOIN wide w ON w.k = y.k),
done AS (SELECT doc_id, count(*) FILTER (WHERE k <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE x.text END AS text
FROM documents d LEFT JOIN done x ON x.doc_id = d.doc_id
"""
