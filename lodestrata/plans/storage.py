"""Where plans are cut and tables are published.

Versioned tables: a build writes to a new version folder; a one-row pointer table
tells which version is live, and replacing the pointer is the swap.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and lost executors cost nothing."""
    path = f"{shared_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def live_version(spark: SparkSession, root: str) -> str | None:
    """The live version folder; none if nothing was built or the schema is another version's."""
    try:
        rows = spark.read.json(f"{root}/_live").collect()
    except Exception as e:  # the pointer isn't there yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return rows[0].path if rows and rows[0].schema_version == SCHEMA_VERSION else None


def publish(tables: dict[str, DataFrame], root: str, **manifest: str) -> str:
    """Write tables to a new version beside the live one, then turn the pointer."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{root}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    row = spark.range(1).select(F.lit(path).alias("path"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("built_at"), *[F.lit(v).alias(k) for k, v in manifest.items()])
    row.coalesce(1).write.mode("overwrite").json(f"{root}/_live")
    return path


def read_live(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = live_version(spark, root)
    if path is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    return spark.read.parquet(f"{path}/{name}")


def log_call(spark: SparkSession, path: str, tool: str, results: int, latency_ms: float, error: str = "") -> None:
    """Append one line to a call log."""
    spark.range(1).select(F.current_timestamp().alias("ts"), F.lit(tool).alias("tool"), F.lit(results).alias("results"), F.lit(latency_ms).alias("latency_ms"), F.lit(error).alias("error")).coalesce(1).write.mode("append").json(path)


def export_json(**frames: DataFrame) -> DataFrame:
    """Kind and row as JSON that can stand in a page's script."""
    out = None
    for kind, df in frames.items():
        part = df.select(F.lit(kind).alias("kind"), F.replace(F.to_json(F.struct("*")), F.lit("</"), F.lit("<\\/")).alias("json"))
        out = part if out is None else out.unionByName(part)
    return out


def split_rejects(df: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others for the dead-letter table."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)
