from __future__ import annotations

import duckdb
import pytest

from lodestrata.plans import registry
from tests.oracle import connect, oracle_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(name, spark, sf_dir, con):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == oracle_rows(con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_gives_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_remember_keeps_every_page_of_a_repeated_url(spark, tmp_path):
    urls = ["http://a/1", "http://a/1", "http://a/22", "http://a/22", "http://a/22", "http://b", "", None, None]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = oracle_rows(con, registry.ORACLES["k08_remember"])
    assert len(want[1]) == len(urls) and spark_rows(registry.QUERIES["k08_remember"](spark, str(tmp_path))) == want


def test_istanbul_reports_stay_small(spark, sf_dir, con, monkeypatch):
    from lodestrata.plans import source_queries

    paths, read = [], source_queries.coverage.istanbul
    monkeypatch.setattr(source_queries.coverage, "istanbul", lambda spark, path, **x: (paths.append(path), read(spark, path, **x))[1])
    monkeypatch.setattr(source_queries, "STATEMENTS", 100, raising=False)
    assert spark_rows(registry.QUERIES["s19_istanbul"](spark, sf_dir)) == oracle_rows(con, registry.ORACLES["s19_istanbul"])
    total = con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    sizes = [r.n for r in spark.read.text(paths[0], wholetext=True).selectExpr("length(value) as n").collect()]
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 8 and sum(sizes) > 60 * total  # no report has a share of the table
