"""Commit history: churn, contributors, co-change, history, line intent.

changes: hash, path, added, removed; commits: hash, author, email, date, message;
blame: path, line, commit, author, email, date, summary, content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.predicates import between_optional

SMALLEST, LARGEST = 2, 50


def churn(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """For each path the number of change rows, lines added and removed, newest date."""
    rows = changes.join(commits.select("hash", "date"), "hash")
    return rows.groupBy("path").agg(F.count("*").alias("commit_count"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"), F.max("date").alias("last_changed"))


def hotspots(changes: DataFrame, commits: DataFrame, limit: int = 20) -> DataFrame:
    """The paths with most changes."""
    return churn(changes, commits).orderBy(F.desc("commit_count"), "path").limit(limit)


def file_contributors(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Per path and email; the author's name of the newest commit."""
    rows = changes.join(commits.select("hash", "email", "author", "date"), "hash")
    return rows.groupBy("path", "email").agg(F.max_by("author", F.struct("date", "hash")).alias("author"), F.count("*").alias("commit_count"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"))


def contributors(per_file: DataFrame, path=None) -> DataFrame:
    """Per email over all paths or one, most changes first."""
    rows = per_file if path is None else per_file.where(F.col("path") == path)
    sums = [F.sum(c).alias(c) for c in ("commit_count", "lines_added", "lines_removed")]
    return rows.groupBy("email").agg(*sums).orderBy(F.desc("commit_count"), "email")


def sized(changes: DataFrame, low: int = SMALLEST, high: int = LARGEST) -> DataFrame:
    """Change rows of commits that have low to high of them.

    Counting first keeps a huge commit from ever being gathered in one place.
    """
    sizes = changes.groupBy("hash").agg(F.count("*").alias("files")).where(F.col("files").between(low, high))
    return changes.join(sizes, "hash")


def cochange(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Unordered pairs of paths that one commit changes, with their number and newest date.

    Pairs are by position, so a path listed twice in a commit pairs with itself.
    Commits hold at most fifty rows here, so pairs are made inside one array.
    """
    lists = sized(changes).groupBy("hash").agg(F.sort_array(F.collect_list("path")).alias("p")).join(commits.select("hash", "date"), "hash")
    n = F.size("p")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.slice(F.col("p"), i + 1, n - i), lambda b: F.struct(F.get(F.col("p"), i - 1).alias("file_a"), b.alias("file_b")))))
    rows = lists.select("date", F.explode(pairs).alias("x"))
    return rows.groupBy("x.file_a", "x.file_b").agg(F.count("*").alias("count"), F.max("date").alias("last_changed"))


def cochange_of(pairs: DataFrame, path, limit: int = 10) -> DataFrame:
    """The pairs that hold a path, most frequent first."""
    return pairs.where((F.col("file_a") == path) | (F.col("file_b") == path)).orderBy(F.desc("count"), "file_a", "file_b").limit(limit)


def recent_commits(commits: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first."""
    return commits.orderBy(F.desc("date"), "hash").limit(limit)


def file_history(changes: DataFrame, commits: DataFrame, path, limit: int = 20) -> DataFrame:
    """The commits of a path, newest first."""
    return commits.join(changes.where(F.col("path") == path).select("hash").distinct(), "hash").orderBy(F.desc("date"), "hash").limit(limit)


def blame_range(blame: DataFrame, path, start: int = 0, end: int = 0) -> DataFrame:
    """A file's lines in an inclusive range; 0 leaves an end open."""
    return blame.where((F.col("path") == path) & between_optional("line", start, end)).orderBy("line")


def line_intent(blame: DataFrame, commits: DataFrame, path=None, line: int | None = None) -> DataFrame:
    """Blame lines with the commit that wrote them, if known."""
    rows = blame if path is None else blame.where((F.col("path") == path) & (F.col("line") == line))
    c = commits.select(F.col("hash").alias("commit"), F.col("date").alias("commit_date"), "message")
    return rows.join(c, "commit", "left")


def number_rows(df: DataFrame, key: str, *order: str, name: str = "seq") -> DataFrame:
    """0, 1, 2 .. within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
