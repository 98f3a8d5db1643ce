"""Byte-level BPE as a reduction over a tree of text halves.

A node of the tree is a stretch of a text with its ids.  A long stretch is halved
(anywhere), both halves are encoded by themselves, and the halves are joined: the
ids near the cut may be wrong, as the cut can go through a word or a merge.  So a
window around the cut is encoded again.  It begins and ends at a place where the
pattern splits whatever comes before or after: in front of white space that
follows a character that is none.  Left of such a place in the left half, and right
of one in the right half, the ids are the same in any longer text, so they stand.
A window that has no such place on one side is doubled on that side, up to the
whole half.  Joining is associative, so any tree gives the same ids; decoding
concatenates the bytes up the same tree.

Null is the empty text: no ids, and the hashes of nothing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import batch, rows_of, short_batches

LEAF, WINDOW = 4096, 32
#: White space that \\s and Python agree on.
BLANKS = " \n"

_CODECS: dict[tuple[str, str], TreeCodec] = {}


class TreeCodec:
    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.leaf = leaf

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.core.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._encode(text, a, mid), self._encode(text, mid, b))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[a:b] from those of text[a:mid] and text[mid:b]."""
        p, size = None, WINDOW
        while p is None:
            p = self._place(text, max(a, mid - size), mid, last=True, edge=a)
            size *= 2
        q, size = None, WINDOW
        while q is None:
            q = self._place(text, mid, min(b, mid + size), last=False, edge=b)
            size *= 2
        drop, need = 0, len(text[p:mid].encode())
        while need > 0:
            drop += 1
            need -= len(self.bytes_of[left[-drop]])
        skip, need_r = 0, len(text[mid:q].encode())
        while need_r > 0:
            need_r -= len(self.bytes_of[right[skip]])
            skip += 1
        if need or need_r:
            raise AssertionError("a token crosses a place where the pattern splits")
        left = left[: len(left) - drop]
        left += self.core.encode_ordinary(text[p:q])
        left += right[skip:] if skip else right
        return left

    @staticmethod
    def _place(text: str, lo: int, hi: int, last: bool, edge: int) -> int | None:
        """A safe place in text[lo:hi], the nearest to the cut; the half's far edge if the window has come to it; else None."""
        places = range(hi - 1, lo, -1) if last else range(lo + 1, hi)
        for i in places:
            if text[i] in BLANKS and not text[i - 1].isspace():
                return i
        return edge if (lo if last else hi) == edge else None

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.core.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def codec(ranks_path: str, pattern: str) -> TreeCodec:
    """The worker process's codec."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = TreeCodec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """For each row doc_id, n_tokens, the hashes of ids and decoded bytes, and with_ids the ids and the bytes themselves."""
    short_batches(docs.sparkSession)
    digest = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = f"{digest}, ids array<int>, decoded binary" if with_ids else digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            ids = [c.encode(t) if t else [] for t in texts]
            raw = [c.decode(x) for x in ids]
            # a list's text form has the ids with ", " between them
            cols = batch(digest, doc_id=doc_ids, n_tokens=[len(x) for x in ids], ids_sha256=[hashlib.sha256(str(x)[1:-1].replace(" ", "").encode()).hexdigest() for x in ids], decoded_sha256=[hashlib.sha256(x).hexdigest() for x in raw])
            if with_ids:
                cols = pa.RecordBatch.from_arrays([*cols.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())], [*cols.schema.names, "ids", "decoded"])
            yield cols

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)
