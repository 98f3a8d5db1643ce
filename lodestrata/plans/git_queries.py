"""Queries over commit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import git
from lodestrata.plans.registry import query
from lodestrata.plans.testbed import BLAME, CHANGES, COMMITS, Bed, sql

CHURN = "churn AS (SELECT path, count(*) AS commit_count, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(removed) AS BIGINT) AS lines_removed, max(date) AS last_changed FROM changes JOIN commits USING (hash) GROUP BY path)"
PER_FILE = "per_file AS (SELECT path, email, max(author) AS author, count(*) AS commit_count, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(removed) AS BIGINT) AS lines_removed FROM changes JOIN commits USING (hash) GROUP BY path, email)"
NUMBERED = "sized AS (SELECT c.*, row_number() OVER (PARTITION BY c.hash ORDER BY path) AS pos FROM changes c JOIN (SELECT hash FROM changes GROUP BY hash HAVING count(*) BETWEEN 2 AND 50) s ON s.hash = c.hash)"
PAIRS = "pairs AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS count, max(date) AS last_changed FROM sized a JOIN sized b ON a.hash = b.hash AND a.pos < b.pos JOIN commits c ON c.hash = a.hash GROUP BY 1, 2)"


@query("a01_churn", sql(COMMITS, CHANGES, CHURN, body="SELECT * FROM churn"))
def a01_churn(spark, d):
    b = Bed(spark, d)
    return git.churn(b.changes(), b.commits())


@query("a01_hotspots", sql(COMMITS, CHANGES, CHURN, body="SELECT * FROM churn ORDER BY commit_count DESC, path LIMIT 20"))
def a01_hotspots(spark, d):
    b = Bed(spark, d)
    return git.hotspots(b.changes(), b.commits())


@query("a02_file_contributors", sql(COMMITS, CHANGES, PER_FILE, body="SELECT * FROM per_file"))
def a02_file_contributors(spark, d):
    b = Bed(spark, d)
    return git.file_contributors(b.changes(), b.commits())


@query("a03_contributors", sql(COMMITS, CHANGES, PER_FILE, body="SELECT email, CAST(sum(commit_count) AS BIGINT) AS commit_count, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_removed) AS BIGINT) AS lines_removed FROM per_file GROUP BY email"))
def a03_contributors(spark, d):
    b = Bed(spark, d)
    return git.contributors(git.file_contributors(b.changes(), b.commits()))


@query("n08_commit_size_guard", sql(CHANGES, body="SELECT hash, count(*) AS files FROM changes GROUP BY hash HAVING count(*) BETWEEN 2 AND 50"))
def n08_commit_size_guard(spark, d):
    return git.sized(Bed(spark, d).changes()).groupBy("hash").agg(F.count("*").alias("files"))


@query("j10_cochange", sql(COMMITS, CHANGES, NUMBERED, PAIRS, body="SELECT * FROM pairs"))
def j10_cochange(spark, d):
    b = Bed(spark, d)
    return git.cochange(b.changes(), b.commits())


@query("j11_cochange_of_file", sql(COMMITS, CHANGES, NUMBERED, PAIRS, body="SELECT * FROM pairs WHERE file_a = 7 OR file_b = 7 ORDER BY count DESC, file_a, file_b LIMIT 10"))
def j11_cochange_of_file(spark, d):
    b = Bed(spark, d)
    return git.cochange_of(git.cochange(b.changes(), b.commits()), 7)


@query("s07_recent_commits", sql(COMMITS, body="SELECT * FROM commits ORDER BY date DESC, hash LIMIT 20"))
def s07_recent_commits(spark, d):
    return git.recent_commits(Bed(spark, d).commits())


@query("j09_file_history", sql(COMMITS, CHANGES, body="SELECT * FROM commits WHERE hash IN (SELECT hash FROM changes WHERE path = 7) ORDER BY date DESC, hash LIMIT 20"))
def j09_file_history(spark, d):
    b = Bed(spark, d)
    return git.file_history(b.changes(), b.commits(), 7)


@query("s06_blame_range", sql(BLAME, body="SELECT * FROM blame WHERE path = 7 AND line >= 3 AND line <= 12"))
def s06_blame_range(spark, d):
    return git.blame_range(Bed(spark, d).blame(), 7, 3, 12)


@query("j12_line_intent", sql(BLAME, COMMITS, body="SELECT path, line, b.commit, b.date, c.date AS commit_date, message FROM blame b LEFT JOIN commits c ON c.hash = b.commit"))
def j12_line_intent(spark, d):
    b = Bed(spark, d)
    return git.line_intent(b.blame(), b.commits()).select("path", "line", "commit", "date", "commit_date", "message")
