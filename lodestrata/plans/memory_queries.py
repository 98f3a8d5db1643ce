"""Queries over the temporal fact store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.predicates import match_tier, valid_at
from lodestrata.operators import memory as M
from lodestrata.plans.registry import query
from lodestrata.plans.scalar_queries import NORM, SLUG
from lodestrata.plans.testbed import ENTITIES, FACTS, Bed, sql

STARTS = "starts AS (SELECT src, relation, dst, asserted FROM (SELECT *, lag(dst) OVER (PARTITION BY src, relation ORDER BY asserted, dst) AS earlier FROM assertions) WHERE earlier IS NULL OR earlier <> dst)"
VALID = "facts AS (SELECT src, relation, dst, asserted AS valid_from, CASE WHEN n IS NULL THEN NULL ELSE greatest(n, asserted) END AS invalid_at FROM (SELECT *, lead(asserted) OVER (PARTITION BY src, relation ORDER BY asserted, dst) AS n FROM starts))"
SIDES = "sides AS (SELECT src AS slug, src, relation, dst, valid_from FROM facts WHERE invalid_at IS NULL UNION ALL SELECT dst, src, relation, dst, valid_from FROM facts WHERE invalid_at IS NULL AND dst <> src)"
AS_OF = "2024-01-15 00:00:00"


def _facts(b: Bed):
    return M.close_intervals(b.facts())


@query("n07_validity", sql(FACTS, STARTS, VALID, body="SELECT * FROM facts"))
def n07_validity(spark, d):
    return _facts(Bed(spark, d))


@query("f10_as_of", sql(FACTS, STARTS, VALID, body=f"SELECT * FROM facts WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}')"))
def f10_as_of(spark, d):
    return _facts(Bed(spark, d)).where(valid_at(F.lit(AS_OF).cast("timestamp_ntz")))


@query("f10_current", sql(FACTS, STARTS, VALID, body="SELECT * FROM facts WHERE invalid_at IS NULL"))
def f10_current(spark, d):
    return _facts(Bed(spark, d)).where(valid_at())


@query("j23_facts_about", sql(FACTS, STARTS, VALID, body="SELECT * FROM facts WHERE (src = 'k-1' OR dst = 'k-1') AND invalid_at IS NULL"))
def j23_facts_about(spark, d):
    return M.facts_about(_facts(Bed(spark, d)), "k-1")


@query("n05_topk_facts", sql(FACTS, STARTS, VALID, SIDES, body="SELECT slug, src, relation, dst, valid_from, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY slug ORDER BY valid_from DESC, src, relation, dst) AS INTEGER) AS rank FROM sides) WHERE rank <= 3"))
def n05_topk_facts(spark, d):
    return M.top_facts(_facts(Bed(spark, d)), 3).select("slug", "src", "relation", "dst", "valid_from", "rank")


@query("a11_glossary", sql(FACTS, STARTS, VALID, SIDES, ENTITIES, body="SELECT e.slug, coalesce(degree, 0) AS degree, concat(e.slug, ': ', array_to_string(aliases, ', ')) AS line FROM entities e LEFT JOIN (SELECT slug, count(*) AS degree FROM sides GROUP BY slug) s USING (slug) ORDER BY degree DESC, e.slug LIMIT 200"))
def a11_glossary(spark, d):
    b = Bed(spark, d)
    return M.glossary(b.entities(), _facts(b))


@query("f09_match_tier", sql(ENTITIES, body=f"SELECT slug, CASE WHEN {NORM.format(x='name')} = 'building' OR list_contains(list_transform(aliases, lambda a: {NORM.format(x='a')}), 'building') THEN 0 WHEN contains(slug, 'building') OR contains({NORM.format(x='name')}, 'building') THEN 1 END AS tier FROM entities"))
def f09_match_tier(spark, d):
    return Bed(spark, d).entities().select("slug", match_tier(F.lit(" Building")).alias("tier"))


ALIASES = f"alias_rows AS (SELECT slug, unnest(list_distinct(list_prepend({NORM.format(x='name')}, list_transform(aliases, lambda a: {NORM.format(x='a')})))) AS alias FROM entities), owners AS (SELECT alias, min(slug) AS slug FROM alias_rows WHERE alias <> '' GROUP BY alias)"


@query("j27_alias_resolve", sql(ENTITIES, ALIASES, body=f"SELECT c_custkey, n AS name, coalesce(o.slug, {SLUG.format(x='n')}) AS slug FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('Cust ', c_custkey) ELSE concat('Unknown: ', c_custkey) END AS n FROM customer) q LEFT JOIN owners o ON o.alias = {NORM.format(x='n')}"))
def j27_alias_resolve(spark, d):
    b = Bed(spark, d)
    k = F.col("c_custkey")
    names = b.raw("customer").select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit("Cust "), k.cast("string"))).otherwise(F.concat(F.lit("Unknown: "), k.cast("string"))).alias("name"))
    return M.resolve_names(names, "name", b.entities())


@query("j24_provenance", sql(FACTS, body="SELECT event_id AS id, ts AS occurred_at FROM events WHERE event_id IN (SELECT episode FROM assertions WHERE dst = 'k-1') ORDER BY ts DESC, event_id LIMIT 10"))
def j24_provenance(spark, d):
    b = Bed(spark, d)
    facts = b.facts().where("dst = 'k-1'").select(F.array("episode").alias("episodes"))
    return M.provenance(facts, b.raw("events").select(F.col("event_id").alias("id"), F.col("ts").alias("occurred_at")))


@query("j25_anti", "SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT o_orderkey * 2 FROM orders)")
def j25_anti(spark, d):
    b = Bed(spark, d)
    return M.new_and_known(b.raw("events").select(F.col("event_id").alias("id")), b.raw("orders").select((F.col("o_orderkey") * 2).alias("id")))[0]


@query("j25_semi", "SELECT event_id AS id FROM events WHERE event_id IN (SELECT o_orderkey * 2 FROM orders)")
def j25_semi(spark, d):
    b = Bed(spark, d)
    return M.new_and_known(b.raw("events").select(F.col("event_id").alias("id")), b.raw("orders").select((F.col("o_orderkey") * 2).alias("id")))[1]


@query("j26_recall", None)
def j26_recall(spark, d):
    """Entities of a name with the number of their facts and newest episodes."""
    b = Bed(spark, d)
    ents = b.entities().withColumn("last_seen", F.lit("2024-01-01").cast("timestamp"))
    facts = _facts(b).withColumn("episodes", F.array(F.concat_ws("|", "src", "relation", "dst")))
    eps = facts.select(F.explode("episodes").alias("id"), F.col("valid_from").alias("occurred_at"))
    return M.recall(ents, facts, eps, "cust 1").select("slug", "name", "tier", "facts", "episodes")


@query("t13_active_entities", "SELECT c_custkey, max(o_orderdate) AS last_seen, concat('user-', c_custkey) AS slug FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAY ORDER BY last_seen DESC, slug LIMIT 10")
def t13_active_entities(spark, d):
    b = Bed(spark, d)
    o = b.raw("orders")
    now = o.agg(F.max("o_orderdate")).first()[0]
    seen = b.raw("customer").join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_seen")).withColumn("slug", F.concat(F.lit("user-"), F.col("c_custkey").cast("string")))
    return M.active_entities(seen, F.lit(now).cast("timestamp_ntz"))


@query("k10_hygiene", sql(ENTITIES, body="SELECT slug, CAST(1 AS INTEGER) AS aliases_dropped, [lower(concat('n-', slug))] AS kept FROM entities"))
def k10_hygiene(spark, d):
    e = Bed(spark, d).entities().withColumn("aliases", F.array(F.lit("the repo"), F.concat(F.lit("n-"), "slug"))).withColumn("repo_refs", F.array().cast("array<string>"))
    return M.hygiene(e).select("slug", "aliases_dropped", "kept")
