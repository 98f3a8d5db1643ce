"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (consecutive windows of its whole text).  Each
passage is encoded; gated attention, learned from document labels alone, says how
much each passage counts; the weighted mean of the encodings is scored.

The model is fitted on the driver in numpy, on at most ``max_train`` labelled
documents (a documented bound; documents are drawn by a hash of doc_id, evenly
from both labels, and the class shares are put right in the intercept).  Of a
document of more than ``max_passages`` passages the fit takes that many, spread
evenly over its whole length, so what the driver gathers has a fixed bound.  Every
document is scored, in whole.

A null or empty text is a bag of one empty passage and gets a score like any
other.  Rows of labels with a null quality or an unknown doc_id have no effect;
repeated label rows count once (the larger label), and of rows that share a doc_id
the fit takes the one with the smallest features, so it doesn't depend on scheduling.  With no usable labels every
score is the prior 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import batch, below, rows_of, short_batches, with_fields

PASSAGE = 512
#: Bytes that are encoded at once.
BLOCK = 1 << 20


def _classes() -> np.ndarray:
    kind = np.full(256, 10, np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[32, 9, 11, 12, 13]], kind[10] = 3, 4
    kind[46], kind[44] = 5, 6
    kind[[33, 63]] = 7
    kind[[ord(c) for c in "#*$%&|<>"]] = 8
    kind[[ord(c) for c in "'\"()-:;"]] = 9
    kind[0x80:0xC0], kind[0xC0:] = 11, 12
    return kind


KIND = _classes()
KINDS = 13
MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256)
LOWER[65:91] += 32
MIX = MIX[LOWER]
PLACE = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
N_FEATURES = KINDS * KINDS + 5


def _encode(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Features of n passages; starts: where each passage's bytes begin in data."""
    lengths = np.diff(np.append(starts, len(data)))
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(data):
        return out
    of = np.repeat(np.arange(n), lengths)
    kind = KIND[data]
    after = np.append(kind[1:], 3)
    after[(starts + lengths - 1)[lengths > 0]] = 3
    grams = np.bincount(of * (KINDS * KINDS) + kind * KINDS + after, minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, : KINDS * KINDS] = np.sqrt(grams / np.maximum(lengths, 1)[:, None])
    solid = (kind != 3) & (kind != 4)
    fresh = np.zeros(len(data), bool)
    fresh[starts[lengths > 0]] = True
    first = solid & (fresh | ~np.append(False, solid[:-1]))
    at = np.flatnonzero(first)
    if len(at):
        run = np.cumsum(first) - 1
        place = np.arange(len(data)) - at[np.maximum(run, 0)]
        code = np.add.reduceat(np.where(solid, MIX[data] * PLACE[place & 63], np.uint64(0)), at)
        owner = of[at]
        words = np.bincount(owner, minlength=n)
        twice = np.zeros(len(at), bool)
        twice[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((code, owner))
        c, o = code[order], owner[order]
        new = np.append(True, (c[1:] != c[:-1]) | (o[1:] != o[:-1]))
        some = np.maximum(words, 1)
        solids = np.bincount(of[solid], minlength=n)
        out[:, -5] = np.bincount(owner[twice], minlength=n) / some
        out[:, -4] = np.bincount(o[new], minlength=n) / some
        out[:, -3] = solids / some / 10
        out[:, -2] = np.minimum(words / 100, 2)
    out[:, -1] = lengths / PASSAGE
    return out


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and each text's number of passages."""
    feats, counts, held, starts, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal size
        if starts:
            feats.append(_encode(np.frombuffer(b"".join(held), np.uint8), np.array(starts), len(starts)))
            held.clear()
            starts.clear()
            size = 0

    for t in texts:
        raw = (t or "").encode()
        counts.append(max(1, -(-len(raw) // PASSAGE)))
        for i in range(0, max(len(raw), 1), BLOCK):
            part = raw[i : i + BLOCK]
            starts += [size + j for j in range(0, max(len(part), 1), PASSAGE)]
            held.append(part)
            size += len(part)
            if size >= BLOCK:
                flush()
    flush()
    return np.concatenate(feats) if feats else np.zeros((0, N_FEATURES), np.float32), np.array(counts, np.int64)


def spread(n: int, most: int) -> np.ndarray:
    """All of n places, or most of them at even distances, the first and the last among them."""
    return np.arange(n) if n <= most else np.linspace(0, n - 1, most).round().astype(np.int64)


class GatedAttention:
    """tanh encoder, gated attention over the passages of a bag, logistic score."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 1):
        r = np.random.default_rng(seed)
        n = N_FEATURES
        self.p = {
            "W": r.normal(0, n**-0.5, (hidden, n)), "b": np.zeros(hidden),
            "V": r.normal(0, hidden**-0.5, (gate, hidden)), "bv": np.zeros(gate),
            "U": r.normal(0, hidden**-0.5, (gate, hidden)), "bu": np.zeros(gate),
            "w": r.normal(0, 0.1, gate), "c": r.normal(0, 0.1, hidden), "d": np.zeros(1),
        }
        self.mean, self.scale, self.shift = np.zeros(n), np.ones(n), 0.0

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p, first = self.p, np.append(0, np.cumsum(counts)[:-1])
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ p["W"].T + p["b"])
        t, s = np.tanh(h @ p["V"].T + p["bv"]), 1 / (1 + np.exp(-(h @ p["U"].T + p["bu"])))
        g = (t * s) @ p["w"]
        e = np.exp(g - np.maximum.reduceat(g, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return first, bag, h, t, s, a, z, z @ p["c"] + p["d"][0]

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 4e-3, size: int = 64) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        x = ((x - self.mean) / self.scale).astype(np.float64)
        first = np.append(0, np.cumsum(counts))
        r, m, v, step = np.random.default_rng(2), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), size):
                bags = order[i : i + size]
                rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in bags])
                grads = self._grads(x[rows], counts[bags], y[bags])
                step += 1
                lr = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _grads(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        first, bag, h, t, s, a, z, logit = self._forward(x, counts)
        dl = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = np.outer(dl, p["c"])[bag]
        da = (h * dz).sum(1)
        dg = a * (da - np.add.reduceat(a * da, first)[bag])
        dts = np.outer(dg, p["w"])
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dpre = (a[:, None] * dz + dt @ p["V"] + ds @ p["U"]) * (1 - h * h)
        return {"W": dpre.T @ x, "b": dpre.sum(0), "V": dt.T @ h, "bv": dt.sum(0), "U": ds.T @ h, "bu": ds.sum(0), "w": (t * s).T @ dg, "c": z.T @ dl, "d": np.array([dl.sum()])}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        logit = self._forward((x - self.mean) / self.scale, counts)[-1] + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, max_train: int = 4000, max_passages: int = 64) -> GatedAttention | None:
    """Fit on labelled rows of docs that may_learn allows: max_train at most, max_passages of each at most."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(share) < 2:
        return None
    rate = F.when(F.col("quality") == 1, F.lit(max_train / 2 / share[1])).otherwise(F.lit(max_train / 2 / share[0]))
    # bounded by max_train ids: a scan of documents with these ids, no shuffle of texts
    ids = known.where(below(rate, "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, marks in rows_of(batches, "doc_id", "text", "quality"):
            x, counts = passages(texts)
            bags = [x[e - c : e][spread(c, max_passages)].astype(np.float32).tobytes() for e, c in zip(np.cumsum(counts), counts)]
            yield batch("doc_id long, quality int, x binary", doc_id=doc_ids, quality=marks, x=bags)

    told = chosen.mapInArrow(run, "doc_id long, quality int, x binary")
    rows = told.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows], float)
    if len(set(y)) < 2:
        return None
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    model = GatedAttention()
    model.fit(np.concatenate(bags), np.array([len(b) for b in bags]), y)
    model.shift = float(np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_quality(docs: DataFrame, model: GatedAttention | None, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold) beside its own columns."""
    spark = docs.sparkSession
    short_batches(spark)
    told = spark.sparkContext.broadcast(model)  # a few thousand weights
    docs = docs.drop("score", "predicted")  # older answers
    out = with_fields(docs.schema, score=T.DoubleType(), predicted=T.IntegerType())
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            s = told.value.scores(*passages(texts)) if told.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names)

    return docs.mapInArrow(run, out)
