"""Streams: debounce, expiry, deduplicated ingest, claims, per-key sequences.

Each function takes a streaming (or batch) DataFrame and gives one; ``drain`` runs a
stream over all that is there, for sinks that are called with whole batches.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET, LATE, TTL, COOLDOWN = "300 milliseconds", "10 seconds", "30 minutes", "2 seconds"


def debounced(changes: DataFrame, quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """Repo, started, ended, events: one row for each burst of changes (repo, ts) that a quiet period ends."""
    seen = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy("repo", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("events")).select("repo", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def windowed_counts(events: DataFrame, key: str, size: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Events of each kind in each window; what comes later than ``late`` is left out."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("started"), key, "events")


def once(rows: DataFrame, key: str = "id", ts: str = "started_at", within: str = TTL) -> DataFrame:
    """Each id once; what is remembered of an id goes when the time is over."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def _claims(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    winner = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["at", "agent"])
    out = []
    for r in rows.itertuples(index=False):
        won = winner is None
        winner = r.agent if won else winner
        out.append((key[0], key[1], r.agent, won, winner))
    state.update((winner,))
    yield pd.DataFrame(out, columns=["room_id", "task_id", "agent", "won", "winner"])


def claims(events: DataFrame) -> DataFrame:
    """Each claim (room_id, task_id, agent, at) with whether it won; across batches a task has exactly one winner."""
    return events.groupBy("room_id", "task_id").applyInPandasWithState(_claims, "room_id long, task_id long, agent string, won boolean, winner string", "winner string", "append", GroupStateTimeout.NoTimeout)


def _numbered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values(["at", "body"])
    seq = range(n + 1, n + len(rows) + 1)
    ok = [not r or 0 < r < s for r, s in zip(rows["reply_to"].fillna(0), seq)]
    state.update((n + len(rows),))
    yield pd.DataFrame({"room_id": key[0], "seq": list(seq), "body": rows["body"].tolist(), "reply_ok": ok})


def numbered(messages: DataFrame) -> DataFrame:
    """Messages (room_id, body, reply_to, at) with a number that only grows in their room, and whether they answer an earlier one."""
    return messages.groupBy("room_id").applyInPandasWithState(_numbered, "room_id long, seq long, body string, reply_ok boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Give all that is there to a sink, batch by batch, and stop; the checkpoint tells where the next drain goes on."""
    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def every(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cooldown: str = COOLDOWN) -> StreamingQuery:
    """A sink that is called once in a cooldown at most, with all changes since."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=cooldown).start()


def idempotent(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A sink that appends rows whose key the table at path doesn't hold yet; a batch that comes again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            there = batch.sparkSession.read.parquet(path).select(key)
            fresh = fresh.join(there, key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return write


def watched(spark, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """New JSON lines files of a folder as a stream."""
    os.makedirs(folder, exist_ok=True)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)
