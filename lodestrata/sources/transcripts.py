"""Agent sessions, run folders and seed notes as episodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalars import content_text, redact, stable_id, trimmed

LIMIT, LEAST_TURNS = 16_000, 3
EPISODE = "source string, source_ref string, text string, occurred_at timestamp, cwd string"


def lines_of(raw: bytes, offset: int = 0) -> Iterator[tuple[int, int, str]]:
    """Start, end and text of each complete line behind offset; a last line without line feed only if it is whole JSON."""
    pos = offset
    for part in raw[offset:].splitlines(keepends=True):
        text = part.decode("utf-8", "replace").strip()
        if not part.endswith(b"\n"):
            try:
                json.loads(text)
            except ValueError:
                return
        yield pos, pos + len(part), text
        pos += len(part)


def session_lines(spark: SparkSession, path: str, offsets: dict[str, int] | None = None) -> DataFrame:
    """path, start, stop, line of session files, each behind its offset."""
    known = spark.sparkContext.broadcast(offsets or {})  # a number for each open session

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, a, b, t) for p, raw in zip(pdf["path"], pdf["content"]) for a, b, t in lines_of(bytes(raw), known.value.get(p, 0))]
            yield pd.DataFrame(rows, columns=["path", "start", "stop", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, start long, stop long, line string")


def session_turns(lines: DataFrame) -> DataFrame:
    """Substantive user and assistant turns of sessions with one message in each line."""
    j = F.from_json("line", "type string, timestamp string, cwd string, message struct<role:string>")
    rows = lines.withColumn("j", j).where(F.col("j.type").isin("user", "assistant") & F.col("j.message").isNotNull())
    text = content_text(F.get_json_object("line", "$.message.content"))
    raw = F.get_json_object("line", "$.message.content")
    text = F.when(F.ltrim(raw).startswith("["), text).otherwise(F.trim(raw))
    return rows.select("path", "start", "stop", F.coalesce(F.nullif("j.message.role", F.lit("")), "j.type").alias("role"), text.alias("text"), F.try_to_timestamp("j.timestamp").alias("ts"), F.col("j.cwd").alias("cwd")).where(F.trim("text") != "")


def rollout_turns(lines: DataFrame) -> DataFrame:
    """Turns of sessions whose lines are envelopes; the working folder stands in the first record alone."""
    j = F.from_json("line", "timestamp string, type string, payload struct<type:string,role:string,cwd:string,name:string,content:array<struct<type:string,text:string>>>")
    rows = lines.withColumn("j", j)
    cwd = rows.where("j.type = 'session_meta'").groupBy("path").agg(F.min_by("j.payload.cwd", "start").alias("cwd"))
    item = rows.where("j.type = 'response_item'")
    said = F.array_join(F.transform(F.filter("j.payload.content", lambda b: b["type"].isin("input_text", "output_text", "text")), lambda b: F.trim(b["text"])), "\n")
    call = F.concat(F.lit("[tool: "), F.coalesce("j.payload.name", F.lit("unknown")), F.lit("]"))
    kind = F.col("j.payload.type")
    text = F.when((kind == "message") & F.col("j.payload.role").isin("user", "assistant"), said).when(kind.isin("function_call", "custom_tool_call"), call)
    role = F.when(kind == "message", F.col("j.payload.role")).otherwise("assistant")
    return item.select("path", "start", "stop", role.alias("role"), text.alias("text"), F.try_to_timestamp("j.timestamp").alias("ts")).where(F.trim(F.coalesce("text", F.lit(""))) != "").join(cwd, "path", "left")


def chunks(turns: list[tuple], limit: int = LIMIT) -> list[list[int]]:
    """Turn numbers of each episode.

    Greedy up to limit bytes; the first turn always fits; an episode of two turns or
    more hands its last one on to the next.
    """
    out, i = [], 0
    sizes = [len(t.encode()) for t in turns]
    while i < len(turns):
        j, used = i, 0
        while j < len(turns) and (j == i or used + sizes[j] <= limit):
            used += sizes[j]
            j += 1
        out.append(list(range(i, j)))
        if j >= len(turns):
            break
        i = j - 1 if j - 1 > i else j
    return out


def episodes(turns: DataFrame, source: str, limit: int = LIMIT, least: int = LEAST_TURNS) -> DataFrame:
    """Id, source, source_ref, text, occurred_at, cwd.

    One session is folded in one task, as where it is cut depends on the cut before.
    Sessions of fewer than ``least`` turns give none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "stop"], ignore_index=True)
        said = [f"{'User' if r == 'user' else 'Assistant' if r == 'assistant' else r}: {t}\n\n" for r, t in zip(pdf["role"], pdf["text"])]
        cuts = chunks(said, limit) if len(said) >= least else []
        rows = [(source, f"{pdf['path'][0]}#{pdf['start'][c[0]]}-{pdf['stop'][c[-1]]}", "".join(said[k] for k in c), pdf["ts"][c[0]], pdf["cwd"][c[0]]) for c in cuts]
        return pd.DataFrame(rows, columns=["source", "source_ref", "text", "occurred_at", "cwd"])

    made = turns.groupBy("path").applyInPandas(run, EPISODE)
    return made.select(stable_id("source_ref").alias("id"), "source", "source_ref", redact("text").alias("text"), "occurred_at", "cwd")


def run_folders(spark: SparkSession, pattern: str) -> DataFrame:
    """An episode for each run folder's state.json: its plans and verdicts in order."""
    schema = "name string, status string, spent_usd double, iters array<struct<n:int,plan:string,summary:string,passed:boolean,feedback:string,score:double>>"
    rows = spark.read.schema(schema).json(pattern, multiLine=True).select("*", F.col("_metadata.file_path").alias("source_ref"), F.col("_metadata.file_modification_time").alias("occurred_at"))
    it = F.transform("iters", lambda i: F.concat(F.lit("Iteration "), i["n"].cast("string"), F.lit(": "), F.coalesce(i["summary"], i["plan"], F.lit("")), F.when(i["passed"], " PASS").otherwise(" FAIL"), F.coalesce(F.concat(F.lit("\n"), F.nullif(i["feedback"], F.lit(""))), F.lit(""))))
    return rows.select(stable_id("source_ref").alias("id"), "source_ref", redact(F.concat_ws("\n", F.concat(F.lit("Run "), "name", F.lit(" ("), "status", F.lit(")")), F.array_join(it, "\n"))).alias("text"), "occurred_at")


def seed_notes(spark: SparkSession, path: str) -> DataFrame:
    """An episode for each markdown note: the description of its front matter, then the body."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_ref"))
    front = r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$"
    has = F.col("value").rlike(front)
    head, body = F.regexp_extract("value", front, 1), F.when(has, F.regexp_extract("value", front, 2)).otherwise(F.col("value"))
    told = F.regexp_replace(F.trim(F.regexp_extract(head, r"(?m)^description:\s*(.*)$", 1)), "^[\"']|[\"']$", "")
    return rows.select(stable_id("source_ref").alias("id"), "source_ref", redact(trimmed(F.concat_ws("\n\n", F.nullif(told, F.lit("")), body))).alias("text"))


def quiet_files(spark: SparkSession, path: str, before: str) -> DataFrame:
    """The files below a path that were last changed before a time (ISO), without their content."""
    return spark.read.format("binaryFile").option("modifiedBefore", before).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))
