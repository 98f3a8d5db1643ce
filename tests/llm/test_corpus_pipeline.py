from __future__ import annotations

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
import public_tokenizers as vocab
from lodestrata.llm import common, quality_mil
from tests.llm.test_llm_operators import components_by_hand

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, block string"
COMMON = "This line stands on every site."


def test_stages_and_their_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "language ID", "line dedup", "MinHash near-dedup", "packing"]
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        after = common.written(stage(spark, docs, sf), "t")
        assert after.columns == list(cp.COLUMNS)
        n = after.count()
        assert 0 < n <= before
        if name == "quality classifier":
            kept = {r.doc_id for r in after.select("doc_id").collect()}
            good, bad = [d in kept for d, q in labels.items() if q == 1], [d in kept for d, q in labels.items() if q == 0]
            assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
        if name == "language ID":
            assert n > 0.99 * before
        if name == "MinHash near-dedup":
            assert after.select("text").distinct().count() == n
        docs, before = after, n
    pieces = cp.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == before


def small_tables(spark, path, rows):
    spark.createDataFrame([(*r, len(r[1] or ""), None, "clash") for r in rows], DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int("$" not in (r[1] or "$"))) for r in rows if r[0] is not None and r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def small_rows():
    r, rows = random.Random(5), []
    tongues = {"a": "river stone morning garden letter window silver quiet".split(), "b": "zorv kjax wyqu vekk xolz jyrr qovv zukk".split()}
    for i in range(80):
        lang = "ab"[i % 2]
        body = " ".join(r.choice(tongues[lang]) + str(r.randrange(40)) for _ in range(80))
        if i % 16 < 3:
            body = " ".join("$$ ## || <<>> &&" for _ in range(12))
        rows.append((i, body + ("\n" + COMMON if i % 4 == 0 else ""), lang, f"site{i}"))
    for k in range(3):  # near copies of document 5
        words = rows[5][1].split()
        words[20 + k] = "changed"
        rows.append((100 + k, " ".join(words), "b", "copies"))
    rows += [rows[6], rows[6], (200, None, "a", "s"), (201, "", None, None), (202, "12 34 56", "b", "s"), (None, rows[7][1], "b", "s")]
    return rows


def plain_lines(docs):
    sites, first = {}, {}
    for d in docs:
        for line in {x.strip(" ") for x in d.text.split("\n")} - {""}:
            sites.setdefault(line, set()).add(d.source)
            if d.doc_id is not None:
                first[line] = min(first.get(line, d.doc_id), d.doc_id)
    out = []
    for d in docs:
        seen, left = set(), []
        for line in d.text.split("\n"):
            bad = len(sites.get(line.strip(" "), ())) >= 10
            if not bad or (first[line.strip(" ")] == d.doc_id and line not in seen):
                left.append(line)
            seen.add(line)
        if any(x.strip(" ") for x in left):
            out.append((d.doc_id, "\n".join(left)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_stages_against_plain_versions(spark, tmp_path):
    sf = small_tables(spark, tmp_path / "t", small_rows())
    docs, took, given, kept = common.table(spark, sf, "documents"), {}, {}, {}
    for name, stage in cp.STAGES:
        given[name], took[name] = docs.collect(), docs
        docs = common.written(stage(spark, docs, sf), "t")
        kept[name] = docs.collect()

    before = given["quality classifier"]
    model = quality_mil.train(took["quality classifier"], common.table(spark, sf, "labels"), common.id_crc() % 5 != 0)
    good = [float(model.scores(*quality_mil.passages([d.text]))[0]) >= cp.QUALITY_THRESHOLD for d in before]
    assert in_order([(d.doc_id, d.text or "") for d, g in zip(before, good) if g]) == in_order([(d.doc_id, d.text or "") for d in kept["quality classifier"]])
    assert {i for i in range(80) if i % 16 >= 3} <= {d.doc_id for d in kept["quality classifier"]} and 2 not in {d.doc_id for d in kept["quality classifier"]}

    before, after = given["language ID"], kept["language ID"]
    lettered = in_order([(d.doc_id, d.text) for d in before if any(c.isalpha() for c in d.text or "")])
    assert in_order([(d.doc_id, d.text) for d in after]) == lettered

    assert in_order([(d.doc_id, d.text) for d in kept["line dedup"]]) == in_order(plain_lines(given["line dedup"]))
    assert sum(COMMON in d.text for d in kept["line dedup"]) == 1

    before = [d for d in given["MinHash near-dedup"] if d.doc_id is not None]
    before.sort(key=lambda d: d.doc_id)
    top, _ = components_by_hand([d.text for d in before], 5, 80)
    want = {before[t].doc_id for t in top}
    after = kept["MinHash near-dedup"]
    assert sorted(d.doc_id for d in after if d.doc_id is not None) == sorted(want) and not want & {100, 101, 102}
    assert sum(d.doc_id is None for d in after) == 1

    encoder = Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    texts = {d.doc_id: d.text for d in given["packing"]}
    pieces = {}
    for p in kept["packing"]:
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = [*encoder.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_pipeline_of_an_empty_table_and_of_one_that_teaches_nothing(spark, tmp_path):
    assert cp.run(spark, small_tables(spark, tmp_path / "none", [])).count() == 0
    rows = [(1, "Some words that nobody marked.", None, "s"), (1, "Some words that nobody marked.", None, "s"), (2, None, None, None)]
    spark.createDataFrame([(*r, 0, None, "clash") for r in rows], DOCUMENTS).write.parquet(f"{tmp_path}/u/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/u/labels.parquet")
    assert sorted(r.doc_id for r in cp.run(spark, f"{tmp_path}/u").collect()) == [1, 2]
