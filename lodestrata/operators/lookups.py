"""Reads by key and plain full reads in the order that the stores keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(table: DataFrame, **key) -> DataFrame:
    """the row of a primary key (column=value); the filter reaches the scan."""
    return table.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key.items()]))


def request_by_id(requests: DataFrame, request_id) -> DataFrame:
    """a captured request by its id, its newest form."""
    return requests.where(F.col("id") == request_id).orderBy(F.desc("started_at")).limit(1)


def of_type(entities: DataFrame, kind: str = "") -> DataFrame:
    """entities of a type, of all for none, by slug."""
    return (entities.where(F.col("type") == kind) if kind else entities).orderBy("slug")


def since(episodes: DataFrame, at: Column | None = None) -> DataFrame:
    """episodes from a time on; all for none."""
    return episodes if at is None else episodes.where(F.col("occurred_at") >= at)


def with_prefix(table: DataFrame, column: str, prefix: str, keys_only: bool = False) -> DataFrame:
    """Rows whose key begins with a prefix; their keys alone if nothing else is wanted."""
    rows = table.where(F.col(column).startswith(prefix))
    return rows.select(column) if keys_only else rows


def all_nodes(nodes: DataFrame) -> DataFrame:
    """Every node by key."""
    return nodes.orderBy("type", "id")


def all_edges(edges: DataFrame) -> DataFrame:
    """Every edge by key."""
    return edges.orderBy("src", "type", "dst")


def all_communities(labels: DataFrame) -> DataFrame:
    """Every community with its members."""
    return labels.groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members")).orderBy("community")


def all_entities(entities: DataFrame) -> DataFrame:
    """Every entity by slug."""
    return entities.orderBy("slug")


def all_facts(facts: DataFrame) -> DataFrame:
    """Every fact by key."""
    return facts.orderBy("src", "relation", "dst", "valid_from")


def all_episodes(episodes: DataFrame) -> DataFrame:
    """Every episode by id."""
    return episodes.orderBy("id")


def all_cursors(cursors: DataFrame) -> DataFrame:
    """Every cursor by path."""
    return cursors.orderBy("path")


def upserted(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Table after rows, which replace those of the same key (episodes by id, cursors by path)."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows.select(*table.columns))
