"""The temporal fact store: recall, provenance, glossary, orientation, hygiene, merging.

entities: slug, name, type, description, aliases, repo_refs, created_at, last_seen;
facts: src, relation, dst, fact, valid_from, invalid_at, confidence, episodes;
episodes: id, source, source_ref, summary, occurred_at.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.predicates import durable, is_ephemeral, is_generic_alias, is_generic_name, match_tier, valid_at
from lodestrata.functions.scalars import ancestors, array_union_keep, name_set, normalize, normalize_relation, parse_valid_from, slugify

# Relations of which one object is current at a time.
EXCLUSIVE = ("deployed_on", "status", "replaced_by")
MAX_REFS, ACTIVE_DAYS, ACTIVE, ORIENT_BUDGET = 6, 14, 10, 1500


def facts_about(facts: DataFrame, slug: str, include_invalid: bool = False) -> DataFrame:
    """Facts on either side of a slug; one about itself comes once."""
    rows = facts.where((F.col("src") == slug) | (F.col("dst") == slug))
    return rows if include_invalid else rows.where(valid_at())


def alias_table(entities: DataFrame) -> DataFrame:
    """Alias (normalized) and slug; of several owners the smallest slug."""
    return entities.select("slug", F.explode(name_set("name", "aliases")).alias("alias")).groupBy("alias").agg(F.min("slug").alias("slug"))


def resolve_names(df: DataFrame, name: str, entities: DataFrame, out: str = "slug") -> DataFrame:
    """The entity that a name or alias belongs to, else the slug made of the name."""
    known = alias_table(entities).select(F.col("alias").alias("__a"), F.col("slug").alias("__s"))
    return df.join(known, normalize(name) == F.col("__a"), "left").withColumn(out, F.coalesce("__s", slugify(name))).drop("__a", "__s")


def provenance(facts: DataFrame, episodes: DataFrame, limit: int = 10) -> DataFrame:
    """The episodes that facts trace back to, newest first."""
    ids = facts.select(F.explode("episodes").alias("id")).distinct()
    return episodes.join(ids, "id").orderBy(F.desc("occurred_at"), "id").limit(limit)


def new_and_known(incoming: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id no episode has, and the others."""
    ids = episodes.select("id")
    return incoming.join(ids, "id", "left_anti"), incoming.join(ids, "id", "left_semi")


def rank_entities(entities: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """Entities that match, exact names first, then the last seen."""
    return entities.withColumn("tier", match_tier(F.lit(q))).where("tier is not null").orderBy("tier", F.desc("last_seen"), "slug").limit(limit)


def recall(entities: DataFrame, facts: DataFrame, episodes: DataFrame, q: str, as_of: Column | None = None, limit: int = 5, newest: int = 5) -> DataFrame:
    """Matching entities with their facts at a time and the newest episodes behind them."""
    hits = rank_entities(entities, q, limit).select("slug", "name", "tier", "last_seen")
    now = facts.where(valid_at(as_of))
    sides = now.withColumn("slug", F.explode(F.array_distinct(F.array("src", "dst")))).join(F.broadcast(hits.select("slug")), "slug")  # limit rows
    per = sides.groupBy("slug").agg(F.count("*").alias("facts"))
    eps = sides.select("slug", F.explode("episodes").alias("id")).distinct().join(episodes.select("id", "occurred_at"), "id")
    top = eps.withColumn("r", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("occurred_at"), "id"))).where(F.col("r") <= newest).groupBy("slug").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("episodes"))
    return hits.join(per, "slug", "left").join(top, "slug", "left").fillna(0, ["facts"])


def glossary(entities: DataFrame, facts: DataFrame, limit: int = 200) -> DataFrame:
    """Entities by the number of their current facts, each with its aliases."""
    degree = facts.where(valid_at()).select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("slug")).groupBy("slug").agg(F.count("*").alias("degree"))
    rows = entities.join(degree, "slug", "left").fillna(0, ["degree"])
    line = F.when(F.size("aliases") > 0, F.concat(F.col("slug"), F.lit(": "), F.array_join("aliases", ", "))).otherwise(F.col("slug"))
    return rows.select("slug", "degree", line.alias("line")).orderBy(F.desc("degree"), "slug").limit(limit)


def top_facts(facts: DataFrame, k: int = 3) -> DataFrame:
    """Each entity's newest current facts."""
    sides = facts.where(valid_at()).withColumn("slug", F.explode(F.array_distinct(F.array("src", "dst"))))
    order = Window.partitionBy("slug").orderBy(F.desc("valid_from"), "src", "relation", "dst")
    return sides.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def active_entities(entities: DataFrame, now: Column, limit: int = ACTIVE) -> DataFrame:
    """Entities seen in the last two weeks, the last seen first."""
    return entities.where(F.col("last_seen") >= now - F.expr(f"interval {ACTIVE_DAYS} days")).orderBy(F.desc("last_seen"), "slug").limit(limit)


def repo_entities(entities: DataFrame, cwd: str) -> DataFrame:
    """Entities of the nearest ancestor of a path that any entity refers to."""
    cands = entities.sparkSession.range(1).select(F.posexplode(ancestors(F.lit(cwd))).alias("depth", "ref"))
    met = entities.withColumn("ref", F.explode("repo_refs")).join(F.broadcast(cands), "ref")
    nearest = met.agg(F.min("depth").alias("depth"))
    return met.join(F.broadcast(nearest), "depth").drop("ref", "depth").dropDuplicates(["slug"])


def orient(entities: DataFrame, facts: DataFrame, cwd: str, now: Column, budget: int = ORIENT_BUDGET, header: str = "## Memory", footer: str = "") -> str:
    """A short text on what is known here; bullets go from the end until it fits."""
    here = repo_entities(entities, cwd)
    texts = top_facts(facts, 3).groupBy("slug").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "fact"))), lambda x: x["fact"]).alias("texts"))
    told = here.join(texts, "slug", "left").orderBy("slug").select("name", "type", "texts").collect()
    others = active_entities(entities.join(here.select("slug"), "slug", "left_anti"), now).join(texts, "slug", "left").orderBy(F.desc("last_seen"), "slug").collect()
    repo = [f"- **{r.name}** ({r.type}): {'; '.join(r.texts or [])}" for r in told]
    active = [f"- {r.name}: {(r.texts or [''])[0]}" for r in others]
    while True:
        lines = [header, *([f"### This repo ({cwd.rstrip('/').rsplit('/', 1)[-1]})", *repo] if repo else []), *(["### Recently active", *active] if active else []), *([footer] if footer else [])]
        text = "\n".join(lines)
        if len(text.encode()) <= budget or not (active or repo):
            return text
        (active or repo).pop()


def within_budget(df: DataFrame, text: str, budget: int, *order: str) -> DataFrame:
    """The rows of a small result that fit into a budget of bytes, in order."""
    running = F.sum(F.octet_length(text) + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", running).where(F.col("used") <= budget)


def hygiene(entities: DataFrame, refs_with_git: DataFrame | None = None, home: str = "/Users/") -> DataFrame:
    """Per entity the cleaned lists, how much went, and whose slugs its aliases equal.  Writing the result is the caller's choice."""
    odd = is_ephemeral("name") | is_ephemeral("slug") | is_generic_name("name")
    refs = F.filter("repo_refs", lambda r: r.startswith(home))
    rows = entities.withColumn("odd", odd).withColumn("kept", durable("aliases")).withColumn("refs", refs)
    if refs_with_git is not None:
        live = rows.select("slug", F.explode("refs").alias("ref")).join(refs_with_git.select("ref"), "ref", "left_semi").groupBy("slug").agg(F.collect_set("ref").alias("live"))
        rows = rows.join(live, "slug", "left").withColumn("refs", F.filter("refs", lambda r: F.array_contains(F.coalesce("live", F.array().cast("array<string>")), r)))
    rows = rows.withColumn("refs", F.when(F.size("refs") > MAX_REFS, F.slice("refs", -MAX_REFS, MAX_REFS)).otherwise(F.col("refs")))
    real = rows.where("not odd").select(F.col("slug").alias("other"), F.col("name").alias("other_name"))
    clash = rows.select("slug", F.explode("kept").alias("a")).withColumn("other", slugify("a")).where("other <> slug").join(real, "other").groupBy("slug").agg(F.sort_array(F.collect_set("other_name")).alias("collides_with"))
    out = rows.join(clash, "slug", "left")
    return out.select("slug", "name", "odd", "kept", "refs", (F.size("aliases") - F.size("kept")).alias("aliases_dropped"), (F.size("repo_refs") - F.size("refs")).alias("refs_dropped"), F.coalesce("collides_with", F.array().cast("array<string>")).alias("collides_with"))


def close_intervals(assertions: DataFrame) -> DataFrame:
    """Validity of an exclusive relation from its assertions (src, relation, dst, at): a run of one object ends when another begins."""
    order = Window.partitionBy("src", "relation").orderBy("at", "dst")
    before = F.lag("dst").over(order)
    starts = assertions.withColumn("new", before.isNull() | (before != F.col("dst"))).where("new")
    ends = F.lead("at").over(order)
    return starts.withColumn("n", ends).select("src", "relation", "dst", F.col("at").alias("valid_from"), F.when(F.col("n").isNotNull(), F.greatest("n", "at")).alias("invalid_at"))


def merge_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities after mentions (name, type, description, aliases, cwd_ref, at); names that are ephemeral or generic are left out.

    Descriptions only fill gaps, last_seen only grows, aliases and the newest six
    repo refs are united.
    """
    fine = mentions.where(~(is_ephemeral("name") | is_generic_name("name")))
    named = resolve_names(fine, "name", entities).where("slug <> ''")
    first = F.struct("at", "name")
    new = named.groupBy("slug").agg(
        F.min_by("name", first).alias("n_name"), F.min_by("type", first).alias("n_type"), F.max_by("description", F.when(F.coalesce("description", F.lit("")) != "", -F.unix_micros(F.col("at").cast("timestamp")))).alias("n_desc"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", durable("aliases").alias("a")))), lambda x: x["a"]))).alias("n_aliases"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("cwd_ref").isNotNull(), F.struct("at", "cwd_ref")))), lambda x: x["cwd_ref"])).alias("n_refs"), F.min("at").alias("n_first"), F.max("at").alias("n_last"),
    )
    both = entities.join(new, "slug", "full")
    none = F.array().cast("array<string>")
    refs = array_union_keep(F.coalesce("repo_refs", none), F.coalesce("n_refs", none))
    return both.select("slug", F.coalesce("name", "n_name").alias("name"), F.coalesce("type", "n_type").alias("type"), F.coalesce(F.nullif("description", F.lit("")), "n_desc", F.lit("")).alias("description"), array_union_keep(F.coalesce("aliases", none), F.coalesce("n_aliases", none)).alias("aliases"), F.when(F.size(refs) > MAX_REFS, F.slice(refs, -MAX_REFS, MAX_REFS)).otherwise(refs).alias("repo_refs"), F.coalesce("created_at", "n_first").alias("created_at"), F.greatest("last_seen", "n_last").alias("last_seen"))


FACT = "src string, relation string, dst string, fact string, valid_from timestamp, invalid_at timestamp, confidence double, episodes array<string>"


def _fold(rows: Iterable[dict], exclusive: tuple[str, ...]) -> list[dict]:
    """K04-K06 on one subject: stored facts, then the incoming ones by episode."""
    stored = {(r["relation"], r["dst"], r["valid_from"]): r for r in rows if r["order"] == 0}
    current = lambda rel, dst: next((f for f in sorted(stored.values(), key=lambda f: f["valid_from"]) if f["relation"] == rel and f["dst"] == dst and f["invalid_at"] is None), None)
    incoming: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["order"] > 0:
            incoming.setdefault((r["at"], r["episode"]), []).append(r)
    for (at, episode), group in sorted(incoming.items()):
        merged = set()
        for i, r in enumerate(group):  # restated facts first
            if r["hint"] or not (f := current(r["relation"], r["dst"])):
                continue
            if episode not in f["episodes"]:
                f["episodes"] = [*f["episodes"], episode]
            f["confidence"] = max(f["confidence"], r["confidence"])
            if r["valid_from"] < f["valid_from"]:
                del stored[f["relation"], f["dst"], f["valid_from"]]
                f["valid_from"] = r["valid_from"]
                stored[f["relation"], f["dst"], f["valid_from"]] = f
            merged.add(i)
        for i, r in enumerate(group):
            if r["hint"]:
                if f := current(r["relation"], r["dst"]):
                    f["invalid_at"] = max(at, f["valid_from"])
                continue
            if i in merged:
                continue
            if r["relation"] in exclusive:
                for f in stored.values():
                    if f["relation"] == r["relation"] and f["dst"] != r["dst"] and f["invalid_at"] is None:
                        f["invalid_at"] = max(at, f["valid_from"])
            stored[r["relation"], r["dst"], r["valid_from"]] = r | {"invalid_at": None, "episodes": [episode]}
    return list(stored.values())


def apply_facts(facts: DataFrame, claims: DataFrame, entities: DataFrame, episodes: DataFrame, exclusive: tuple[str, ...] = EXCLUSIVE) -> DataFrame:
    """Facts after claims.

    claims: episode, at, src, relation, dst, fact, valid_from (text), confidence,
    hint (true for a fact that is superseded).  Claims of known episodes do nothing.
    Endpoints are resolved by name; relations that normalize to nothing drop out.
    Late claims are always taken: an earlier valid_from moves the fact back.
    """
    fresh = claims.join(episodes.select(F.col("id").alias("episode")), "episode", "left_anti")
    named = resolve_names(resolve_names(fresh, "src", entities, "s"), "dst", entities, "d")
    ready = named.select(F.col("s").alias("src"), normalize_relation("relation").alias("relation"), F.col("d").alias("dst"), "fact", parse_valid_from("valid_from", "at").alias("valid_from"), F.lit(None).cast("timestamp").alias("invalid_at"), "confidence", F.array().cast("array<string>").alias("episodes"), "episode", "at", F.coalesce("hint", F.lit(False)).alias("hint"), F.lit(1).alias("order")).where("src <> '' and dst <> '' and relation <> ''")
    old = facts.select("src", "relation", "dst", "fact", "valid_from", "invalid_at", "confidence", "episodes", F.lit("").alias("episode"), F.lit(None).cast("timestamp").alias("at"), F.lit(False).alias("hint"), F.lit(0).alias("order"))
    touched = old.join(ready.select("src").distinct(), "src", "left_semi")
    same = facts.join(ready.select("src").distinct(), "src", "left_anti")
    names = [f.split()[0] for f in FACT.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: (None if not isinstance(v, (list,)) and not hasattr(v, "__len__") and pd.isna(v) else v) for k, v in r.items()} for r in pdf.to_dict("records")]
        for r in rows:
            r["episodes"] = list(r["episodes"]) if r["episodes"] is not None else []
        return pd.DataFrame([{k: r[k] for k in names} for r in _fold(rows, exclusive)], columns=names)

    return same.select(*names).unionByName(touched.unionByName(ready).groupBy("src").applyInPandas(run, FACT))


def invalidate(facts: DataFrame, src: str, relation: str, dst: str, at: Column) -> DataFrame:
    """Every current fact of a triple ends."""
    hit = (F.col("src") == src) & (F.col("relation") == relation) & (F.col("dst") == dst) & F.col("invalid_at").isNull()
    return facts.withColumn("invalid_at", F.when(hit, F.greatest(at, "valid_from")).otherwise(F.col("invalid_at")))


def describe(entities: DataFrame, slug: str, description: str) -> DataFrame:
    """A description is replaced on purpose."""
    return entities.withColumn("description", F.when(F.col("slug") == slug, description).otherwise(F.col("description")))


def generic_aliases(entities: DataFrame) -> DataFrame:
    return entities.select("slug", F.explode("aliases").alias("alias")).where(is_generic_alias("alias"))


def remember(episodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Episodes and those of texts (source_ref, text, at) that aren't known yet, without secrets."""
    from lodestrata.functions.scalars import redact, stable_id

    made = texts.select(stable_id("source_ref").alias("id"), F.lit("manual").alias("source"), "source_ref", redact("text").alias("summary"), F.col("at").alias("occurred_at"))
    return episodes.select("id", "source", "source_ref", "summary", "occurred_at").unionByName(new_and_known(made, episodes)[0])


EXTRACTED = "summary string, entities array<struct<name:string,type:string,description:string,aliases:array<string>>>, facts array<struct<src:string,relation:string,dst:string,fact:string,valid_from:string,confidence:double>>"


def extracted(episodes: DataFrame, extractor, glossary: DataFrame | None = None) -> DataFrame:
    """Id, raw, result and parse_ok of each episode (id, text).

    extractor: a function from a prompt to an answer, given from outside; an answer
    that isn't one JSON object is tried twice more.  Rows that aren't parse_ok belong
    into the dead-letter table (plans.storage.split_rejects).
    """
    from lodestrata.functions.scalars import extraction_prompt, fenced_json

    lines = [r.line for r in glossary.select("line").limit(200).collect()] if glossary is not None else []

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        import json
        import re

        out = []
        for p in prompts:
            answer = ""
            for _ in range(3):
                answer = extractor(p) or ""
                try:
                    json.loads(re.search(r"(?s)\{.*\}", answer)[0])
                    break
                except (TypeError, ValueError):
                    continue
            out.append(answer)
        return pd.Series(out)

    prompt = extraction_prompt("text", F.array(*[F.lit(x) for x in lines]).cast("array<string>"))
    rows = episodes.select("id", ask(prompt).alias("raw"))
    result = F.from_json(fenced_json("raw"), EXTRACTED)
    return rows.withColumn("result", result).withColumn("parse_ok", F.col("result.facts").isNotNull() | F.col("result.entities").isNotNull())


def hygiene_counters(cleaned: DataFrame) -> DataFrame:
    """One row of what hygiene() found."""
    return cleaned.agg(
        F.count("*").alias("entities"),
        F.count_if("odd").alias("odd"),
        F.coalesce(F.sum("aliases_dropped"), F.lit(0)).alias("aliases_dropped"),
        F.coalesce(F.sum("refs_dropped"), F.lit(0)).alias("refs_dropped"),
        F.count_if(F.size("collides_with") > 0).alias("collisions"),
    )


def reread(episodes: DataFrame, sources: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The episodes (source_ref and more) of sources (path, mod_time) that changed since their cursor, all of each, and the cursors after it."""
    seen = cursors.select("path", F.col("mod_time").alias("__seen"))
    changed = sources.join(seen, "path", "left").where("__seen is null or mod_time <> __seen").select("path", "mod_time")
    whole = episodes.withColumn("path", F.split_part("source_ref", F.lit("#"), F.lit(1))).join(changed.select("path"), "path", "left_semi").drop("path")
    return whole, cursors.join(changed.select("path"), "path", "left_anti").select("path", "mod_time").unionByName(changed)


class Ingest:
    """What an ingest run asks of the store: the glossary, commits of extracted episodes, cursors."""

    def __init__(self, entities: DataFrame, facts: DataFrame, episodes: DataFrame, cursors: DataFrame):
        self.entities, self.facts, self.episodes, self.cursors = entities, facts, episodes, cursors

    def glossary(self, limit: int = 200) -> DataFrame:
        return glossary(self.entities, self.facts, limit)

    def commit(self, episodes: DataFrame, mentions: DataFrame, claims: DataFrame) -> None:
        """Take in episodes (id, source, source_ref, summary, occurred_at), the entities that they mention and their claims; known ones change nothing."""
        fresh, _ = new_and_known(episodes, self.episodes)
        self.entities = merge_entities(self.entities, mentions)
        self.facts = apply_facts(self.facts, claims, self.entities, self.episodes)
        self.episodes = self.episodes.unionByName(fresh.select(*self.episodes.columns))

    def put_cursor(self, cursors: DataFrame) -> None:
        """Cursors by path."""
        self.cursors = self.cursors.join(cursors.select("path"), "path", "left_anti").unionByName(cursors.select(*self.cursors.columns))
