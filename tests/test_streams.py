from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestrata.plans import storage
from lodestrata.streaming import operators as R


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_debounce_equals_batch(spark, tmp_path):
    rows = [{"repo": "r", "ts": f"2024-01-01T00:00:00.{ms:03d}Z"} for ms in (0, 100, 350, 900, 950)] + [{"repo": "q", "ts": "2024-01-01T00:01:00Z"}]
    put(tmp_path / "in", "a.json", rows)
    schema = "repo string, ts timestamp"
    batch = R.debounced(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert sorted((r.repo, r.events) for r in batch.collect()) == [("q", 1), ("r", 2), ("r", 3)]
    got = []
    stream = R.debounced(R.watched(spark, str(tmp_path / "in"), schema))
    R.drain(stream, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    assert sorted((r.repo, r.events) for r in got) == [("r", 2), ("r", 3)]  # the last burst is still open


def test_one_winner_across_batches(spark, tmp_path):
    schema = "room_id long, task_id long, agent string, at timestamp"
    put(tmp_path / "in", "a.json", [{"room_id": 1, "task_id": 1, "agent": a, "at": "2024-01-01T00:00:0" + s} for a, s in (("x", "2Z"), ("y", "1Z"))])
    got = []
    sink = lambda df, n: got.extend(df.collect())
    R.drain(R.claims(R.watched(spark, str(tmp_path / "in"), schema)), sink, str(tmp_path / "ck"))
    put(tmp_path / "in", "b.json", [{"room_id": 1, "task_id": 1, "agent": "z", "at": "2023-01-01T00:00:00Z"}])
    R.drain(R.claims(R.watched(spark, str(tmp_path / "in"), schema)), sink, str(tmp_path / "ck"))
    assert [(r.agent, r.won) for r in got] == [("y", True), ("x", False), ("z", False)]


def test_numbers_go_on(spark, tmp_path):
    schema = "room_id long, body string, reply_to long, at timestamp"
    got = []
    for k, rows in enumerate(([("a", 0), ("b", 1)], [("c", 2), ("d", 9)])):
        put(tmp_path / "in", f"{k}.json", [{"room_id": 1, "body": b, "reply_to": r, "at": f"2024-01-0{k + 1}T00:00:00Z"} for b, r in rows])
        R.drain(R.numbered(R.watched(spark, str(tmp_path / "in"), schema)), lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    assert [(r.body, r.seq, r.reply_ok) for r in got] == [("a", 1, True), ("b", 2, True), ("c", 3, True), ("d", 4, False)]


def test_sink_takes_each_id_once(spark, tmp_path):
    sink = R.idempotent(str(tmp_path / "out"))
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, v int")
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_versions_swap(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert storage.live_version(spark, root) is None
    storage.publish({"x": spark.range(2)}, root)
    old = storage.read_live(spark, root, "x")
    storage.publish({"x": spark.range(5)}, root)
    assert storage.read_live(spark, root, "x").count() == 5 and old.count() == 2
    good, bad = storage.split_rejects(spark.range(4), F.col("id") > 1)
    assert (good.count(), bad.count()) == (2, 2)
    assert "</" not in storage.export_json(x=spark.createDataFrame([("</script>",)], "t string")).first().json
