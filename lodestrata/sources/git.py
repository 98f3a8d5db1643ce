"""Commit logs and line authorship from git's own text output."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions.scalars import change_status, collapse_rename

#: Record and field signs of the log format; git prints them as they are.
RECORD, FIELD = "\x1e", "\x1f"
LOG_FORMAT = RECORD + FIELD.join(("%H", "%an", "%ae", "%at", "%s")) + FIELD
BLAME = "path string, line int, commit string, author string, email string, date long, summary string, content string"


def parse_log(text: DataFrame) -> DataFrame:
    """Commits with their changes from ``git log --numstat`` output (column value), written with LOG_FORMAT."""
    records = text.select(F.explode(F.split("value", RECORD)).alias("r")).where(F.trim("r") != "")
    p = F.split("r", FIELD)
    stat = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    number = lambda s, i: F.coalesce(F.regexp_extract(s, stat, i).try_cast("int"), F.lit(0))
    lines = F.filter(F.split(F.get(p, F.lit(5)), "\n"), lambda s: s.rlike(stat))
    change = lambda s: F.struct(collapse_rename(F.regexp_extract(s, stat, 3)).alias("path"), number(s, 1).alias("added"), number(s, 2).alias("removed"), change_status(number(s, 1), number(s, 2)).alias("status"))
    at = lambda i: F.get(p, F.lit(i))
    return records.select(at(0).alias("hash"), at(1).alias("author"), at(2).alias("email"), at(3).cast("long").alias("date"), at(4).alias("message"), F.transform(lines, change).alias("files"))


def parse_blame(path: str, porcelain: str) -> Iterator[tuple]:
    """Rows of ``git blame --porcelain``; a commit's header stands only once."""
    known: dict[str, dict[str, str]] = {}
    commit, line, head = "", 0, {}
    for raw in porcelain.split("\n"):
        if raw.startswith("\t"):
            yield (path, line, commit, head.get("author", ""), head.get("author-mail", "").strip("<>"), int(head.get("author-time", 0)), head.get("summary", ""), raw[1:])
            continue
        word, _, rest = raw.partition(" ")
        if len(word) == 40 and all(c in "0123456789abcdefABCDEF" for c in word):
            commit, line = word, int(rest.split(" ")[1])
            head = known.setdefault(commit, {})
        elif word:
            head[word] = rest


def blame_rows(texts: DataFrame) -> DataFrame:
    """The rows of porcelain texts (path, porcelain), file by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in BLAME.split(", ")]
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["porcelain"]):
                yield pd.DataFrame(list(parse_blame(path, text or "")), columns=names)

    return texts.select("path", "porcelain").mapInPandas(run, BLAME)


class BlameSource(DataSource):
    """Line authorship of a repository's tracked files, a partition for each file (options: repo)."""

    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self) -> str:
        return BLAME

    def reader(self, schema) -> DataSourceReader:
        return _BlameReader(self.options["repo"])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _BlameReader(DataSourceReader):
    def __init__(self, repo: str):
        self.repo = repo

    def _git(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.repo, *args], capture_output=True, text=True, errors="replace", check=True).stdout

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self._git("ls-files", "-z").split("\0") if p]

    def read(self, partition: _File) -> Iterator[tuple]:
        return parse_blame(partition.path, self._git("blame", "--porcelain", "--", partition.path))


def log_of(spark: SparkSession, repo: str, depth: int = 0) -> DataFrame:
    """The commits of a repository on this machine, all of them for depth 0."""
    out = subprocess.run(["git", "-C", repo, "log", f"--format={LOG_FORMAT}", "--numstat", *([f"-n{depth}"] if depth else [])], capture_output=True, text=True, errors="replace", check=True).stdout
    return parse_log(spark.createDataFrame([(out,)], "value string"))


def head(repo: str) -> str | None:
    """The commit that HEAD names; empty without a commit, None where git can't tell."""
    try:
        r = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, text=True)
        inside = subprocess.run(["git", "-C", repo, "rev-parse", "--git-dir"], capture_output=True)
    except OSError:
        return None
    return r.stdout.strip() if r.returncode == 0 else "" if inside.returncode == 0 else None
