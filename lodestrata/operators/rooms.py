"""Task boards and append-only channels.

messages: room_id, seq, task_id, sender, kind, body, created_at, reply_to, verdict,
severity; task_events: room_id, task_id, agent, action, at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.predicates import TRANSITIONS, message_is_valid


def read_since(messages: DataFrame, room, cursor: int = 0, limit: int = 50) -> DataFrame:
    """A room's messages behind a cursor, in order; the next cursor is the largest seq."""
    return messages.where((F.col("room_id") == room) & (F.col("seq") > cursor)).orderBy("seq").limit(limit)


def next_cursor(page: DataFrame, cursor: int) -> int:
    return page.agg(F.max("seq")).first()[0] or cursor


def with_sequence(messages: DataFrame) -> DataFrame:
    """Seq 1, 2, 3 .. within each room."""
    return messages.withColumn("seq", F.row_number().over(Window.partitionBy("room_id").orderBy("created_at", "sender", "body")))


def accepted(messages: DataFrame) -> DataFrame:
    """Valid messages whose reply_to, if any, is an earlier message of the room."""
    there = messages.select(F.col("room_id").alias("__r"), F.col("seq").alias("__s"))
    ok = messages.where(message_is_valid())
    answered = ok.where("reply_to > 0").join(there, (F.col("room_id") == F.col("__r")) & (F.col("reply_to") == F.col("__s")) & (F.col("reply_to") < F.col("seq")), "left_semi")
    return ok.where("coalesce(reply_to, 0) = 0").unionByName(answered)


def claims(events: DataFrame) -> DataFrame:
    """The winner of each task is the first to claim it."""
    first = F.struct("at", "agent")
    return events.where("action = 'claim'").groupBy("room_id", "task_id").agg(F.min_by("agent", first).alias("winner"), F.count("*").alias("attempts"))


def legal_moves(moves: DataFrame) -> DataFrame:
    """status changes (old, new) that are allowed."""
    table = moves.sparkSession.createDataFrame(list(TRANSITIONS), "old string, new string")  # seven rows
    return moves.join(F.broadcast(table), ["old", "new"], "left_semi")


def rooms_newest_first(rooms: DataFrame, limit: int = 0) -> DataFrame:
    """T11."""
    out = rooms.orderBy(F.desc("created_at"), "room_id")
    return out.limit(limit) if limit else out


def tasks_oldest_first(tasks: DataFrame, room) -> DataFrame:
    """T11."""
    return tasks.where(F.col("room_id") == room).orderBy("created_at", "task_id")


def room_of_run(rooms: DataFrame, run_id: str) -> DataFrame:
    """The newest room of a run."""
    return rooms.where(F.col("run_id") == run_id).orderBy(F.desc("created_at"), "room_id").limit(1)


def with_room(rooms: DataFrame, room_id: str, run_id: str, repo: str, at: Column) -> DataFrame:
    """Rooms and a new open one."""
    if not run_id:
        raise ValueError("run_id is required")
    new = rooms.sparkSession.range(1).select(F.lit(room_id).alias("room_id"), F.lit(run_id).alias("run_id"), F.lit(repo).alias("repo"), F.lit("open").alias("status"), at.cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("closed_at"))
    return rooms.unionByName(new)


def closed(rooms: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """Rooms after those of wanted (room_id) are closed; a room that is closed already keeps its time."""
    hit = rooms.join(wanted.select("room_id").distinct().withColumn("__hit", F.lit(True)), "room_id", "left")
    now = F.coalesce("__hit", F.lit(False)) & (F.col("status") != "closed")
    return hit.withColumn("closed_at", F.when(now, at.cast("timestamp")).otherwise(F.col("closed_at"))).withColumn("status", F.when(now, "closed").otherwise(F.col("status"))).drop("__hit")


TASK_MOVE = "room_id long, task_id long, action string, agent string, at timestamp, accepted boolean, status string, claimed_by string, reason string"


def moved(moves: DataFrame, rooms: DataFrame | None = None) -> DataFrame:
    """Each move (room_id, task_id, action, agent, at) with whether it counts and the task's state after it.

    action: post, claim, or the status to go to.  A task is posted once, claimed while
    it is open or abandoned, and goes on as the transitions allow; a task that is
    abandoned belongs to nobody.  A room (room_id, status) that is closed takes no posts
    and claims.  Moves of a task are taken by time, then agent and action; one task's
    moves are folded together, as each depends on the ones before.
    """
    allowed = frozenset(TRANSITIONS)
    rows = moves.select("room_id", "task_id", "action", "agent", F.col("at").cast("timestamp").alias("at"))
    shut = F.lit(False)
    if rooms is not None:
        rows = rows.join(rooms.select("room_id", (F.col("status") == "closed").alias("__shut")), "room_id", "left")
        shut = F.coalesce("__shut", F.lit(False))
    rows = rows.select("room_id", "task_id", "action", "agent", "at", shut.alias("shut"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        status, owner, out = None, None, []
        for r in pdf.sort_values(["at", "agent", "action"]).itertuples(index=False):
            reason = None
            if r.action in ("post", "claim") and r.shut:
                reason = "the room is closed"
            elif r.action == "post":
                if status is None:
                    status, owner = "open", None
                else:
                    reason = "the task exists"
            elif status is None:
                reason = "no such task"
            elif r.action == "claim":
                if not r.agent:
                    reason = "agent is required"
                elif status in ("open", "abandoned"):
                    status, owner = "claimed", r.agent
                else:
                    reason = "claimed already"
            elif (status, r.action) in allowed:
                status = r.action
                owner = None if status == "abandoned" else owner
            else:
                reason = "no such transition"
            out.append((r.room_id, r.task_id, r.action, r.agent, r.at, reason is None, status, owner, reason))
        return pd.DataFrame(out, columns=[f.split()[0] for f in TASK_MOVE.split(", ")])

    return rows.groupBy("room_id", "task_id").applyInPandas(run, TASK_MOVE)


def task_states(moves: DataFrame, rooms: DataFrame | None = None) -> DataFrame:
    """Every posted task as its last accepted move left it."""
    last = F.struct("at", "agent", "action")
    done = moved(moves, rooms).where("accepted").groupBy("room_id", "task_id")
    return done.agg(F.max_by("status", last).alias("status"), F.max_by("claimed_by", last).alias("claimed_by"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def posted(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages and the valid ones of new (room_id, sender, kind, body, created_at, reply_to, verdict, severity), numbered on in their rooms."""
    last = messages.groupBy("room_id").agg(F.max("seq").alias("__last"))
    numbered = with_sequence(new).join(last, "room_id", "left").withColumn("seq", (F.col("seq") + F.coalesce("__last", F.lit(0))).cast("long")).drop("__last")
    both = messages.select("room_id", "seq").unionByName(numbered.select("room_id", "seq"))
    there = both.select(F.col("room_id").alias("__r"), F.col("seq").alias("__s"))
    ok = numbered.where(message_is_valid())
    answers = ok.where("reply_to > 0").join(there, (F.col("room_id") == F.col("__r")) & (F.col("reply_to") == F.col("__s")) & (F.col("reply_to") < F.col("seq")), "left_semi")
    return messages.unionByName(ok.where("coalesce(reply_to, 0) = 0").unionByName(answers).select(*messages.columns))
