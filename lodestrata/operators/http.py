"""Captured web requests: list, look up, endpoints, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.predicates import request_matches, shown_body
from lodestrata.functions.scalars import normalize_path

TTL = "30 minutes"


def list_requests(requests: DataFrame, limit: int = 20, **conditions) -> DataFrame:
    """Matching requests, newest first."""
    return requests.where(request_matches(**conditions)).orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def summaries(requests: DataFrame) -> DataFrame:
    """what a list shows of a request."""
    return requests.select("id", "method", "path", "status_code", "started_at")


def shown(requests: DataFrame) -> DataFrame:
    """with binary bodies as their size."""
    return requests.withColumn("body", shown_body("body", "content_type"))


def endpoints(requests: DataFrame) -> DataFrame:
    """Method and normalized path, with the request that showed it first and how many did."""
    rows = requests.withColumn("pattern", F.concat_ws(" ", "method", normalize_path("path")))
    return rows.groupBy("pattern").agg(F.min_by("id", F.struct("started_at", "id")).alias("first_id"), F.count("*").alias("hits"))


def with_expiry(requests: DataFrame, ttl: str = TTL) -> DataFrame:
    """When each request goes."""
    return requests.withColumn("expires_at", F.col("started_at") + F.expr(f"interval {ttl}"))


def alive(requests: DataFrame, now) -> DataFrame:
    return requests.where(F.col("expires_at") > now)


def once(requests: DataFrame) -> DataFrame:
    """A request that was stored twice counts once, in its newest form."""
    return requests.groupBy("id").agg(F.max_by(F.struct(*[c for c in requests.columns if c != "id"]), "started_at").alias("r")).select("id", "r.*")
