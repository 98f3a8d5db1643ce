"""Token ids on disk as directly addressable codes.

An id is cut into chunks of eight bits, lowest first.  Level k holds the k-th
chunk of every id that has one, and a bitmap that says which of these ids go on;
a rank directory counts the bitmap's ones in front of every block of 512 bits.
The i-th id is read by looking at position i of level 0, and while the bit there
is set, at position rank(i) of the next level: one byte and one short popcount a
level, and no block is decoded.

A segment file holds at least one whole document and about ``SEGMENT`` ids, so a
writer's memory is bounded: ``DAC1``, the length of a JSON header, the header
(number of ids, documents, sizes of the parts), then doc ids (int64), document
starts (int64) and for each level chunks (uint8), bitmap (uint8, lowest bit first)
and directory (uint32).

Documents are dealt by ranges of doc_id, so segments of ascending partitions hold
ascending documents.  Names carry a random part: what a lost or repeated task has
written is never taken for a result, as only the manifest rows of tasks that ended
are read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.chunked_encoding import encoder
from lodestrata.llm.common import batch, rows_of, shared_dir, short_batches, written

SEGMENT, BLOCK = 4_000_000, 512
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint32)
MANIFEST = "part long, path string, first_id long, n_ids long, n_docs long"


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) for each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = ONES[np.pad(bits, (0, -len(bits) % (BLOCK // 8)))].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        levels.append(((rest & 255).astype(np.uint8), bits, np.append(0, np.cumsum(ones))[:-1].astype(np.uint32) if len(ones) else np.zeros(0, np.uint32)))
        if not more.any():
            return levels
        rest = rest[more] >> 8


class Segment:
    """One segment file in memory."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a segment of token ids")
        n = int.from_bytes(data[4:8], "little")
        head, at = json.loads(data[8 : 8 + n]), 8 + n
        parts = []
        for kind, size in head["parts"]:
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        self.n_ids, self.doc_ids, self.starts = head["n_ids"], parts[0], parts[1]
        self.levels = [tuple(parts[i : i + 3]) for i in range(2, len(parts), 3)]

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        """The i-th id, by itself."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            whole = bits[block * (BLOCK // 8) : i >> 3]
            i = int(ranks[block]) + int(ONES[whole].sum()) + int(ONES[int(bits[i >> 3]) & ((1 << (i & 7)) - 1)])
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        out, at = np.zeros(self.n_ids, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            more = np.unpackbits(bits, bitorder="little", count=len(chunks)).view(bool)
            if at is None:
                out[:] = chunks
                at = np.flatnonzero(more)
            else:
                out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
                at = at[more]
        return out


def segment_bytes(doc_ids: list[int], starts: list[int], ids: np.ndarray) -> bytes:
    parts = [np.array(doc_ids, np.int64), np.array(starts, np.int64), *(a for level in pack_levels(ids) for a in level)]
    head = json.dumps({"n_ids": len(ids), "parts": [[a.dtype.str, len(a)] for a in parts]}).encode()
    return b"".join([b"DAC1", len(head).to_bytes(4, "little"), head, *(a.tobytes() for a in parts)])


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_token_store(docs: DataFrame, vocabulary: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Encode and write docs in ascending doc_id order; the manifest, a row for each segment.

    docs: doc_id, text; a null text is empty and so only the end id.  Rows with a
    null doc_id come first.  Rows that share a doc_id are all written, in the order
    of their texts' hashes.
    """
    spark = docs.sparkSession
    short_batches(spark)
    out = shared_dir(spark, "tokens")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        where, folder = _opened(out)
        where.create_dir(folder, recursive=True)
        docs_held, starts, blobs, size, before = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal size, before
            name = f"{part:06d}-{uuid.uuid4().hex}.dac"
            with where.open_output_stream(f"{folder}/{name}") as f:
                f.write(segment_bytes(docs_held, starts, np.frombuffer(b"".join(blobs), "<u4")))
            row = batch(MANIFEST, part=[part], path=[f"{out}/{name}"], first_id=[before], n_ids=[size], n_docs=[len(docs_held)])
            before += size
            size = 0
            docs_held.clear()
            starts.clear()
            blobs.clear()
            return row

        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            for d, ids in zip(doc_ids, encoder(vocabulary).encode(texts)):
                docs_held.append(-(1 << 63) if d is None else d)
                starts.append(size)
                blobs += [ids, end]
                size += len(ids) // 4 + 1
                if size >= SEGMENT:
                    yield flush()
        if docs_held:
            yield flush()

    return written(dealt.mapInArrow(run, MANIFEST), "tokens-manifest")


def read_token_store(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the segments."""
    spark = manifest.sparkSession
    sizes = sorted(manifest.groupBy("part").agg(F.sum("n_ids")).collect())  # a row for each writing task
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total))
        total += n
    bases = spark.createDataFrame(base, "part long, base long")
    todo = manifest.join(F.broadcast(bases), "part").select("path", (F.col("base") + F.col("first_id")).alias("start"))
    todo = todo.repartition(max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, starts in rows_of(batches, "path", "start"):
            for path, start in zip(paths, starts):
                where, name = _opened(path)
                with where.open_input_file(name) as f:
                    s = Segment(f.read())
                ids, ends = s.ids().astype("<u4"), np.append(s.starts[1:], s.n_ids)
                yield batch(schema, doc_id=[None if d == -(1 << 63) else int(d) for d in s.doc_ids], start=s.starts + start, n_tokens=ends - s.starts, ids_crc32=[zlib.crc32(ids[a:b]) for a, b in zip(s.starts, ends)])

    return todo.mapInArrow(run, schema)
