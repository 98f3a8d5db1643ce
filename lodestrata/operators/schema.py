"""Database schemas: relations, back references, column flags, search, enums.

tables: name, type, row_estimate; columns: table, name, position, data_type;
foreign_keys: table, column, ref_table, ref_column, name; indexes: table, name,
columns array<string>, is_unique, is_primary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import enum_values


def relations(foreign_keys: DataFrame, table: str) -> DataFrame:
    """Foreign keys out of and into a table; one that refers to its own table is both."""
    out = foreign_keys.where(F.col("table") == table).withColumn("direction", F.lit("outgoing"))
    return out.unionByName(foreign_keys.where(F.col("ref_table") == table).withColumn("direction", F.lit("incoming")))


def referenced_by(tables: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Each table with the keys that refer to it."""
    back = foreign_keys.groupBy(F.col("ref_table").alias("name")).agg(F.sort_array(F.collect_list(F.concat_ws(".", "table", "column"))).alias("referenced_by"))
    return tables.join(back, "name", "left").withColumn("referenced_by", F.coalesce("referenced_by", F.array().cast("array<string>")))


def column_flags(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Columns with is_primary_key and is_unique; only an index of one column makes it unique."""
    each = indexes.select("table", F.explode("columns").alias("name"), "is_primary", (F.col("is_unique") & (F.size("columns") == 1)).alias("alone"))
    flags = each.groupBy("table", "name").agg(F.bool_or("is_primary").alias("is_primary_key"), F.bool_or("alone").alias("is_unique"))
    return columns.join(flags, ["table", "name"], "left").fillna(False, ["is_primary_key", "is_unique"])


def name_tokens(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """A row for each table and each column name, with its table."""
    return tables.select(F.lower("name").alias("token"), F.col("name").alias("table"), F.lit("table").alias("kind")).unionByName(columns.select(F.lower("name").alias("token"), "table", F.lit("column").alias("kind")))


def search(tokens: DataFrame, q: str) -> DataFrame:
    """tokens where ``token:table`` holds the query, whatever its case."""
    return tokens.where(F.concat_ws(":", "token", "table").contains(q.lower())).distinct()


def enums(columns: DataFrame, table: str | None = None, column: str | None = None) -> DataFrame:
    """The members of enum columns, of all or of one table or column."""
    rows = columns.select("table", F.col("name").alias("column"), enum_values("data_type").alias("values")).where("values is not null")
    rows = rows if table is None else rows.where(F.col("table") == table)
    return rows if column is None else rows.where(F.col("column") == column)
