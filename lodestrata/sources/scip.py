"""Symbol index files (protocol buffers, SCIP schema) as rows.

A small reader of the wire format takes the fields that are needed; an index file is
read document by document, so one document is all that is decoded at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.predicates import is_local
from lodestrata.functions.scalars import decode_range, display_name

DEFINITION = 1
# Field numbers of the public schema.
INDEX_DOCUMENT, DOC_PATH, DOC_OCCURRENCE, DOC_SYMBOL = 2, 1, 2, 3
OCC_RANGE, OCC_SYMBOL, OCC_ROLES, OCC_ENCLOSING = 1, 2, 3, 7
SYM_SYMBOL, SYM_DOCUMENTATION, SYM_RELATION, SYM_KIND, SYM_NAME, REL_SYMBOL, REL_IMPLEMENTS = 1, 3, 4, 5, 6, 1, 3
#: First bytes of the fields of an occurrence as they are written nearly always.
_SHORT = frozenset((OCC_RANGE << 3 | 2, OCC_SYMBOL << 3 | 2, OCC_ROLES << 3, OCC_ENCLOSING << 3 | 2))
DOCUMENTS = "file string, occurrences array<struct<symbol:string,range:array<int>,roles:int,enclosing:array<int>>>, symbols array<struct<symbol:string,display_name:string,kind:int,documentation:string,implements:array<string>>>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _next(data: bytes, at: int) -> tuple[int, int | bytes, int]:
    """The field that begins at a place: number, value, and where the next one begins."""
    tag, at = _varint(data, at)
    kind = tag & 7
    if kind == 0:
        value, at = _varint(data, at)
    elif kind == 2:
        n, at = _varint(data, at)
        value, at = data[at : at + n], at + n
    elif kind in (1, 5):
        n = 8 if kind == 1 else 4
        value, at = data[at : at + n], at + n
    else:
        raise ValueError("not a message")
    return tag >> 3, value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message."""
    at = 0
    while at < len(data):
        n, value, at = _next(data, at)
        yield n, value


def _ints(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    if value.isascii():  # each byte is a number
        return list(value)
    out, at = [], 0
    while at < len(value):
        v, at = _varint(value, at)
        out.append(v)
    return out


def _occurrence(v: bytes) -> tuple[str, list[int], int, list[int]]:
    r, s, roles, around, at, end = [], "", 0, [], 0, len(v)
    while at < end:
        # nearly all fields have a tag and a length or value of one byte each
        if at + 1 < end and v[at + 1] < 128 and v[at] in _SHORT:
            k, n, at = v[at] >> 3, v[at + 1], at + 2
            x = n
            if k != OCC_ROLES:
                x, at = v[at : at + n], at + n
        else:
            k, x, at = _next(v, at)
        if k == OCC_SYMBOL:
            s = x.decode()
        elif k == OCC_RANGE:
            r += _ints(x)
        elif k == OCC_ROLES:
            roles = x
        elif k == OCC_ENCLOSING:
            around += _ints(x)
    return s, r, roles, around


def document(data: bytes) -> tuple[str, list[tuple], list[tuple]]:
    path, occurrences, symbols = "", [], []
    for n, v in fields(data):
        if n == DOC_PATH:
            path = v.decode()
        elif n == DOC_OCCURRENCE:
            occurrences.append(_occurrence(v))
        elif n == DOC_SYMBOL:
            s, name, kind, told, bases = "", "", 0, [], []
            for k, x in fields(v):
                if k == SYM_SYMBOL:
                    s = x.decode()
                elif k == SYM_NAME:
                    name = x.decode()
                elif k == SYM_KIND:
                    kind = x
                elif k == SYM_DOCUMENTATION:
                    told.append(x.decode())
                elif k == SYM_RELATION:
                    rel = dict(fields(x))
                    if rel.get(REL_IMPLEMENTS):
                        bases.append(rel.get(REL_SYMBOL, b"").decode())
            symbols.append((s, name, kind, "\n".join(told), bases))
    return path, occurrences, symbols


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets, values = [0], []
    for r in rows:
        values += r
        offsets.append(len(values))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _structs(rows: list[list[tuple]], **columns) -> pa.ListArray:
    """For each row a list of structs; columns: what makes an array of the values of a field."""
    offsets, flat = [0], []
    for r in rows:
        flat += r
        offsets.append(len(flat))
    parts = list(zip(*flat)) or [()] * len(columns)
    arrays = [make(list(x)) for make, x in zip(columns.values(), parts)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, list(columns)))


def _batch(docs: list[tuple[str, list[tuple], list[tuple]]]) -> pa.RecordBatch:
    files, occurrences, symbols = zip(*docs)
    text, number = (lambda x: pa.array(x, pa.string())), (lambda x: pa.array(x, pa.int32()))
    numbers, texts = (lambda x: _lists(x, pa.int32())), (lambda x: _lists(x, pa.string()))
    o = _structs(occurrences, symbol=text, range=numbers, roles=number, enclosing=numbers)
    s = _structs(symbols, symbol=text, display_name=text, kind=number, documentation=text, implements=texts)
    return pa.record_batch([text(list(files)), o, s], ["file", "occurrences", "symbols"])


def documents_of(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """The documents of index files (content); a batch ends with the document that brings it to at_once entries, whatever file it is in."""
    docs, held = [], 0
    for b in batches:
        for raw in b.column(0):
            for n, v in fields(raw.as_py()):
                if n == INDEX_DOCUMENT:
                    docs.append(document(v))
                    held += 1 + len(docs[-1][1]) + len(docs[-1][2])
                    if held >= at_once:
                        yield _batch(docs)
                        docs, held = [], 0
    if docs:
        yield _batch(docs)


def decoded(contents: DataFrame, at_once: int = 20_000) -> DataFrame:
    """A row for each source document of index files (content)."""
    return contents.select("content").mapInArrow(lambda batches: documents_of(batches, at_once), DOCUMENTS)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each source document of the index files below path."""
    return decoded(spark.read.format("binaryFile").load(path))


_BYTE = [bytes([n]) for n in range(128)]


def _bytes_of(n: int) -> bytes:
    if 0 <= n < 128:
        return _BYTE[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _bytes_of(number << 3) + _bytes_of(value)
    return _bytes_of(number << 3 | 2) + _bytes_of(len(value)) + value


def encoded(docs: DataFrame) -> DataFrame:
    """content: an index file with one document for each row of docs (file, occurrences array<struct<symbol, range, roles>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            occurrences, out = b.column(1), []
            rows = occurrences.flatten()
            ranges = rows.field("range")
            symbols, roles, numbers = rows.field("symbol").to_pylist(), rows.field("roles").to_pylist(), ranges.flatten().to_pylist()
            ends = [0, *pc.cumulative_sum(pc.list_value_length(ranges)).to_pylist()]
            start = 0
            for file, n in zip(b.column(0).to_pylist(), pc.list_value_length(occurrences).to_pylist()):
                parts = [_field(DOC_PATH, file.encode())]
                for i in range(start, start + n):
                    packed = b"".join(map(_bytes_of, numbers[ends[i] : ends[i + 1]]))
                    parts.append(_field(DOC_OCCURRENCE, _field(OCC_RANGE, packed) + _field(OCC_SYMBOL, symbols[i].encode()) + _field(OCC_ROLES, roles[i])))
                start += n
                out.append(_field(INDEX_DOCUMENT, b"".join(parts)))
            yield pa.record_batch([pa.array(out, pa.binary())], ["content"])

    return docs.select("file", "occurrences").mapInArrow(run, "content binary")


def occurrences(docs: DataFrame) -> DataFrame:
    """Occurrences of all but local symbols, positions from one."""
    o = docs.select("file", F.explode("occurrences").alias("o")).where(~is_local("o.symbol") & (F.col("o.symbol") != ""))
    return o.select(F.col("o.symbol").alias("symbol"), "file", decode_range("o.range").alias("r"), (F.col("o.roles").bitwiseAND(F.lit(DEFINITION)) != 0).alias("is_definition"), decode_range("o.enclosing").alias("e")).select("symbol", "file", "r.*", "is_definition", F.col("e.line").alias("scope_start"), F.col("e.end_line").alias("scope_stop"))


def symbols(docs: DataFrame) -> DataFrame:
    """C17: symbols, each once."""
    s = docs.select(F.explode("symbols").alias("s")).where(~is_local("s.symbol"))
    return s.groupBy(F.col("s.symbol").alias("symbol")).agg(F.min(F.struct(display_name("s.display_name", "s.symbol").alias("display_name"), F.col("s.kind").alias("kind"), F.col("s.documentation").alias("documentation"))).alias("r")).select("symbol", "r.*")


def impl_edges(docs: DataFrame) -> DataFrame:
    """base, impl."""
    s = docs.select(F.explode("symbols").alias("s"))
    return s.select(F.explode("s.implements").alias("base"), F.col("s.symbol").alias("impl")).distinct()


def with_context(occ: DataFrame, files: DataFrame) -> DataFrame:
    """Each occurrence with its source line; files: file, text."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("n", "l")).select("file", (F.col("n") + 1).alias("line"), F.trim("l").alias("context"))
    return occ.join(lines, ["file", "line"], "left").fillna("", ["context"])
