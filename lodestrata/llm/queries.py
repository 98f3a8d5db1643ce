"""The thin opN queries over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import line_spread
from lodestrata.llm.common import id_crc, table

QUALITY_THRESHOLD = 0.3


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the path is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality_mil import score_quality, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    return score_quality(docs, model, QUALITY_THRESHOLD).select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", "predicted")


def op3_llr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.llr_rules import apply_rules

    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return apply_rules(table(spark, sf_dir, "documents"), trusted)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.token_store import read_token_store, write_token_store

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_store(write_token_store(docs, vocabulary("byte_bpe_50k.json"), end_id=0))


def op5_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.anisotropic_search import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestrata.llm.bpe_tree import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op8_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.language_cnn import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, id_crc() % 4 != 2)
    return identify(docs.drop("lang"), model).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.line_spread import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.chosen_path import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_mil": op2_quality_mil,
    "op3_llr_rules": op3_llr_rules,
    "op4_token_store": op4_token_store,
    "op5_anisotropic_search": op5_anisotropic_search,
    "op6_bpe_tree": op6_bpe_tree,
    "op7_packing": op7_packing,
    "op8_language_cnn": op8_language_cnn,
    "op9_line_spread": op9_line_spread,
    "op10_chosen_path": op10_chosen_path,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op9_line_spread": line_spread.ORACLE_SQL}
