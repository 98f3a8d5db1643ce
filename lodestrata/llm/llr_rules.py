"""Quality rules in DataFrame functions alone: counts of each text and a log-likelihood ratio.

Two multinomials over hashed word n-grams (n = 1, 2) are counted, one over the
trusted target (documents labelled as good), one over the whole raw corpus; every
document takes part in the counts.  A document's ratio is the mean, over its
n-grams, of log(p_target / p_raw).  A document is kept if it passes the base rules
and its ratio is at least ``threshold``.

Null text is text without words: it fails the base rules.  With no trusted document
at all every ratio is 0.  Labels: repeated rows count once; null quality doesn't
count.  Other columns of documents are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams, a power of two: what is collected and sent out has this many rows.
BUCKETS = 1 << 16
#: Trusted ids that may be broadcast (8 bytes each); beyond it the join shuffles.
MOST_BROADCAST = 2_000_000
THRESHOLD = -0.25
#: A word's place takes the low bits of a sort key, its window's hash the high ones.
PLACE_BITS = 24


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def _hash2(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _upto(n: Column, less: int) -> Column:
    """0 .. n - less - 1, or nothing."""
    return F.when(n > less, F.sequence(F.lit(0), n - less - 1)).otherwise(F.array().cast("array<int>"))


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> tuple[list[float], int]:
    """log(p_target / p_raw) of each bucket, add-one smoothed, and the number of trusted n-grams."""
    ids = trusted.select(F.col("doc_id").alias("__id")).distinct().withColumn("__t", F.lit(1))
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    words = docs.select("doc_id", words_of(F.col("text")).alias("w")).join(ids, F.col("doc_id") == F.col("__id"), "left")
    n = F.size("w")
    grams = words.select(F.coalesce("__t", F.lit(0)).alias("t"), F.explode(F.concat(F.transform("w", lambda x: _bucket(F.xxhash64(x))), F.transform(_upto(n, 1), lambda i: _bucket(_hash2(F.col("w"), i))))).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for b, r, t in rows:
        raw[b] += r
        target[b] += t
    found = sum(target) - BUCKETS
    shift = math.log(sum(raw) / sum(target))
    return [math.log(t / r) + shift if found else 0.0 for t, r in zip(target, raw)], found


def _repeats(keys: Column, same, place) -> Column:
    """Sorted places whose window occurs twice; same(a, b) and place(a) read sort keys."""
    m = F.size(keys)
    at = lambda i: F.get(keys, i)
    twin = lambda x, i: F.coalesce(same(at(i - 1), x), F.lit(False)) | F.coalesce(same(x, at(i + 1)), F.lit(False))
    found = F.transform(keys, lambda x, i: F.when(twin(x, i), place(x)))
    return F.when(m > 1, F.sort_array(F.array_compact(found))).otherwise(F.array().cast("array<int>"))


def _covered(places: Column) -> Column:
    """How many words the windows of three at the sorted places cover."""
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, w, and the counts of the base rules."""
    low = (1 << PLACE_BITS) - 1
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    first = docs.select("doc_id", words_of(F.col("text")).alias("w"), F.char_length(bare).cast("long").alias("word_chars"), (F.char_length(bare) - F.char_length(F.translate(bare, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    hashed = first.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform(_upto(F.size("w"), 2), lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))).alias("h"))
    keyed = hashed.withColumn("k", F.sort_array(F.transform("h", lambda x, i: F.shiftleft(F.shiftright(x, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))))
    alike = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), PLACE_BITS) == 0
    full = lambda a: F.get(F.col("h"), a.bitwiseAND(F.lit(low)).cast("int"))
    # windows that share the high bits but not the whole hash, or too many words for the low bits: sort whole hashes
    clash = F.exists(F.transform("k", lambda x, i: F.coalesce(alike(F.get(F.col("k"), i - 1), x) & (full(F.get(F.col("k"), i - 1)) != full(x)), F.lit(False))), lambda x: x) | (F.size("h") > low)
    quick = _repeats(F.col("k"), alike, lambda a: a.bitwiseAND(F.lit(low)).cast("int"))
    marked = keyed.withColumn("whole", F.when(clash, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    exact = _repeats(F.col("whole"), lambda a, b: a["h"] == b["h"], lambda a: a["i"])
    placed = marked.withColumn("places", F.when(F.col("whole").isNull(), quick).otherwise(exact))
    return placed.select("doc_id", "w", "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("places")).cast("long").alias("n_repeat_words"))


def ratio(weights: list[float]) -> Column:
    """Mean weight of the n-grams of column w; 0 without words."""
    table = F.split(F.lit(",".join(f"{x:.5g}" for x in weights)), ",").cast("array<double>")  # folded to one literal
    w = F.col("w")
    ones = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.get(table, _bucket(F.xxhash64(x))))
    twos = F.aggregate(_upto(F.size(w), 1), F.lit(0.0), lambda a, i: a + F.get(table, _bucket(_hash2(w, i))))
    return F.when(F.size(w) > 0, (ones + twos) / (2 * F.size(w) - 1)).otherwise(F.lit(0.0))


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, llr, base_failed and kept of every row of docs.

    docs: doc_id, text; trusted: doc_id of the trusted documents.
    """
    docs = docs.select("doc_id", "text")
    weights, _ = ngram_counts(docs, trusted)
    out = base_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ratio(weights).alias("llr"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
