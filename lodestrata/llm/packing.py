"""Packing of documents into fixed-length sequences, first fit decreasing.

A document longer than a sequence is cut into full sequences and a rest.  Pieces
are dealt at random into groups of about ``GROUP`` pieces; each group is packed by
itself: pieces from the longest to the shortest, each into the first sequence with
room.  A tournament tree over the sequences' free room finds that first sequence in
logarithmic time.  What a group leaves open at its end is less than one sequence in
a few hundred.

A null or empty text is its end id alone.  Rows that share a doc_id are packed each
for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.chunked_encoding import encoder
from lodestrata.llm.common import rows_of, short_batches, written

LENGTH, GROUP = 2048, 4096


class Rooms:
    """Free room of bins in a tournament tree: every inner node holds the most room below it."""

    def __init__(self, n: int, room: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.most = [room] * (2 * self.size)
        self.room = room

    def place(self, length: int) -> int:
        """The first bin with room for length, which is then taken."""
        most, i = self.most, 1
        if most[1] < length:
            raise ValueError("no bin has room")
        while i < self.size:
            i *= 2
            if most[i] < length:
                i += 1
        most[i] -= length
        at = i - self.size
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return at

    def used(self, bin_: int) -> int:
        return self.room - self.most[self.size + bin_]


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; pieces of one length keep their order."""
    rooms, bins, offsets = Rooms(len(lengths), room), [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bins[k] = b = rooms.place(lengths[k])
        offsets[k] = rooms.used(b) - lengths[k]
    return bins, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """The pieces of every document (PIECES)."""
    short_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            rows = []
            for d, ids in zip(doc_ids, encoder(vocabulary).encode(texts)):
                ids += end
                n = len(ids) // 4
                rows += [(d, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = written(pieces, "pieces")  # encoded once, counted and dealt from there
    groups = max(1, round(pieces.count() / group))
    seeded = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit("deal")), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), length)
        # a group has no more sequences than pieces, far below 2**31
        out = pdf.drop(columns="__group")
        out["sequence_id"] = np.array(bins, np.int64) + (int(pdf["__group"].iloc[0]) << 31)
        out["offset"] = np.array(offsets, np.int64)
        return out

    return seeded.groupBy("__group").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH) -> DataFrame:
    return pack(cut(docs, vocabulary, end_id, length), length)
