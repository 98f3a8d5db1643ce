"""Connected components of an undirected graph by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch


def components(edges: DataFrame, most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """id and label (the smallest id reachable) for every id in edges (a, b).

    Each round takes the smallest label among a node and its neighbours and then
    the label's own label, so that chains shorten by more than half; it stops when
    nothing changes.  Every round is written to the shared folder and the one before
    it dropped.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    both = scratch.write(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    first = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    held = scratch.write(first.select("id", F.least("id", "m").alias("label")), "labels")
    labels = held
    for _ in range(most_rounds):
        told = labels.select(F.col("id").alias("b"), "label")
        near = both.join(told, "b").groupBy("a").agg(F.min("label").alias("m"))
        least = F.least("label", F.coalesce("m", "label")).alias("label")
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), least)
        # a label's own label: of the last round, which is never larger than the label itself
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        least = F.least("label", F.coalesce("up", "label")).alias("label")
        after = scratch.write(step.join(up, "label", "left").select("id", "old", least), "labels")
        changed = after.where(F.col("label") < F.col("old")).limit(1).count()
        scratch.drop(held)
        held, labels = after, after.select("id", "label")
        if not changed:
            scratch.drop(both)
            return labels
    raise RuntimeError("components have not settled")
