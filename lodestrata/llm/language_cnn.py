"""Language identification with a convolutional network over bytes.

Bytes are folded into classes (letters without case, one class each for digits,
white space and ASCII punctuation, the bytes of longer characters as they are).
Filters of several widths run over fixed-length windows, each filter's largest
response in the window is kept, and a softmax layer tells the language.  A
document's answer is the mean of its windows' answers; all windows of the whole
text take part.

The network is trained in numpy on the driver, on at most about ``max_docs``
documents a language (a documented bound; drawn by a hash of doc_id).

Null texts and texts without any letter are ``und`` with score 0; without
training rows every text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import below, short_batches, with_fields

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Windows that are run at once.
BLOCK = 256


def _fold() -> np.ndarray:
    kind = np.full(256, 28, np.int64)
    kind[97:123] = kind[65:91] = np.arange(26)
    kind[48:58] = 27
    kind[[32, 9, 10, 11, 12, 13, 0]] = 26
    kind[0x80:] = 29 + np.arange(128)
    return kind


FOLD, KINDS = _fold(), 29 + 128


def windows(text: str) -> np.ndarray:
    """The whole text in rows of WINDOW folded bytes; the last is filled up with spaces."""
    raw = np.frombuffer(text.encode(), np.uint8)
    rows = max(1, -(-len(raw) // WINDOW))
    out = np.full(rows * WINDOW, 26, np.int64)
    out[: len(raw)] = FOLD[raw]
    return out.reshape(rows, WINDOW)


class ByteCnn:
    def __init__(self, langs: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.conv = {w: r.normal(0, 0.3, (w, KINDS, FILTERS)) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS) for w in WIDTHS}
        self.out, self.off = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs))
        self._pairs: dict | None = None

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """For training: pooled responses, and where in the window each came from."""
        best, where = [], {}
        for w in WIDTHS:
            n = WINDOW - w + 1
            y = sum(self.conv[w][j][x[:, j : j + n]] for j in range(w)) + self.bias[w]
            where[w] = y.argmax(1)
            best.append(np.take_along_axis(y, where[w][:, None, :], 1)[:, 0])
        return np.concatenate(best, 1), where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 0.03, size: int = 48) -> None:
        r, step = np.random.default_rng(4), 0
        params = [*self.conv.values(), *self.bias.values(), self.out, self.off]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), size):
                rows = order[i : i + size]
                xb, n = x[rows], len(rows)
                z, where = self._pool(xb)
                a = np.maximum(z, 0)
                d = softmax(a @ self.out + self.off)
                d[np.arange(n), y[rows]] -= 1
                d /= n
                dz = (d @ self.out.T) * (z > 0)
                conv, bias = [], []
                for k, w in enumerate(WIDTHS):
                    g, own = np.zeros_like(self.conv[w]), dz[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(xb, where[w] + j, 1), np.arange(FILTERS)[None, :].repeat(n, 0)), own)
                    conv.append(g)
                    bias.append(own.sum(0))
                step += 1
                lr = rate * (1 - epoch / epochs)
                for p, g, mm, vv in zip(params, [*conv, *bias, a.T @ d, d.sum(0)], m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    p -= lr * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": None}

    def chances(self, x: np.ndarray) -> np.ndarray:
        """For each window the languages' chances; neighbouring filter rows are summed into tables of byte pairs once."""
        if self._pairs is None:
            self._pairs = {w: [(self.conv[w][j][:, None] + self.conv[w][j + 1][None]).reshape(-1, FILTERS).astype(np.float32) if j + 1 < w else self.conv[w][j].astype(np.float32) for j in range(0, w, 2)] for w in WIDTHS}
        out = []
        for i in range(0, len(x), BLOCK):
            b = x[i : i + BLOCK]
            pair, best = b[:, :-1] * KINDS + b[:, 1:], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                y = self._pairs[w][0].take(pair[:, :n], 0, mode="clip")
                for k, t in enumerate(self._pairs[w][1:], 1):
                    y += t.take((pair if len(t) > KINDS else b)[:, 2 * k : 2 * k + n], 0, mode="clip")
                while n > 1:  # halving keeps the maxima over long contiguous rows
                    half = n // 2
                    np.maximum(y[:, :half], y[:, n - half : n], out=y[:, :half])
                    n -= half
                best.append(y[:, 0] + self.bias[w])
            out.append(softmax(np.maximum(np.concatenate(best, 1), 0) @ self.out + self.off))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text, in blocks of windows."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held, owner, size = [], [], 0

        def flush() -> None:
            nonlocal size
            if held:
                c, o = self.chances(np.concatenate(held)), np.concatenate(owner)
                np.add.at(total, o, c)
                np.add.at(n, o, 1)
                held.clear()
                owner.clear()
                size = 0

        spoken = [t is not None and any(map(str.isalpha, t)) for t in texts]
        for k, t in enumerate(texts):
            if spoken[k]:
                held.append(windows(t))
                owner.append(np.full(len(held[-1]), k))
                size += len(held[-1])
                if size >= 16 * BLOCK:
                    flush()
        flush()
        mean = total / np.maximum(n, 1)[:, None]
        top = mean.argmax(1)
        return [self.langs[j] if s else "und" for j, s in zip(top, spoken)], [float(min(1.0, mean[k, j])) if s else 0.0 for k, (j, s) in enumerate(zip(top, spoken))]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, may_learn: Column, max_docs: int = 500, per_doc: int = 2) -> ByteCnn | None:
    """Fit on about max_docs documents of each lang that may_learn allows, per_doc windows of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & may_learn)
    share = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    if not share:
        return None
    rates = F.create_map(*[F.lit(x) for k, n in share.items() for x in (k, min(1.0, max_docs / n))])
    picked = usable.select("doc_id", "lang", "text").where(below(F.element_at(rates, F.col("lang")), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                w = windows(t)
                out.append(w[np.unique(np.linspace(0, len(w) - 1, per_doc).astype(int))].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "lang", "x"])

    rows = picked.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.x))
    langs = sorted({r.lang for r in rows})
    x = [np.frombuffer(r.x, np.uint8).reshape(-1, WINDOW).astype(np.int64) for r in rows]
    if not x:
        return None
    model = ByteCnn(langs)
    model.fit(np.concatenate(x), np.repeat([langs.index(r.lang) for r in rows], [len(w) for w in x]))
    return model


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """docs with lang_pred and score beside its own columns."""
    spark = docs.sparkSession
    short_batches(spark)
    told = spark.sparkContext.broadcast(model)  # a few thousand weights
    docs = docs.drop("lang_pred", "score")  # older answers
    out = with_fields(docs.schema, lang_pred=T.StringType(), score=T.DoubleType())
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            lang, score = told.value.predict(texts) if told.value else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names)

    return docs.mapInArrow(run, out)
