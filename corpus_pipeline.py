"""From documents to packed training sequences.

Quality classifier, language ID, line dedup, near-dedup, packing.  Each stage is a
function (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet
and read again as the next one's docs.  All but the last return the columns of
documents.  No stage can be told in SQL as a whole (learned models), so there is no
oracle; tests/llm compares the stages with plain versions on a small table.

Null and empty texts: quality scores them like any other; what is left of them has no
letter and goes in language ID.  Repeated rows are one group of near-duplicates, of
which one row stays; rows without a doc_id are in no group and stay.  A table without
usable labels or languages teaches nothing: that stage then keeps every document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import chosen_path, language_cnn, line_spread, packing, quality_mil
from lodestrata.llm.common import id_crc, table, written
from lodestrata.llm.queries import QUALITY_THRESHOLD, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its windows agree on no language to this degree.
LANGUAGE_THRESHOLD = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier predicts to be good; all of them if no labels are usable."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    return quality_mil.score_quality(docs.select(*COLUMNS), model, QUALITY_THRESHOLD).where("predicted = 1").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and whose language the network can tell; all of them if none has a language to learn from."""
    model = language_cnn.train(docs, id_crc() % 4 != 2)
    if model is None:
        return docs.select(*COLUMNS)
    told = language_cnn.identify(docs.select(*COLUMNS), model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_THRESHOLD)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those that had no others go."""
    done = line_spread.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))
    return done.where(left).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    Rows that share a doc_id are one document, of which each different text stays once.
    """
    kept = chosen_path.near_duplicates(docs, width=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    with_id = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return with_id.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_dedup),
    ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
