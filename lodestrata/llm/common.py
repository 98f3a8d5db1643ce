"""What the operators share: the shared folder, row selection by hash, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch: documents can be long, so batches stay short.
BATCH_ROWS = 512
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session has its own bound."""
    if spark.conf.get(RECORDS) == "10000":  # the default
        spark.conf.set(RECORDS, str(BATCH_ROWS))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and every executor see.

    It lies in ``spark.checkpoint.dir``.  Only where the session has no such
    setting (tests, one machine) is a local folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator in a folder of their own, each dropped once nothing needs it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, shared_dir(spark, name), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: df as Parquet, read again."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)  # holding out keeps its id its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that write() returned."""
        for df in tables:
            _, path = self.paths.pop(id(df))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


class Recent(dict):
    """What ``make(key)`` gives, remembered for the keys met last: two generations of ``most`` entries at most.

    A full young generation becomes the old one, whose entries come back when they are
    met again; so frequent keys stay, and memory is bounded.
    """

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


_HELD: dict[str, object] = {}


def held(name: str, make):
    """What make() gives, kept under name while this worker process asks for no other name: one operator's cache at a time."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def below(rate: Column, *keys: str) -> Column:
    """True for a share ``rate`` of the rows, chosen by a hash of keys alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1_000_000)) < rate * 1_000_000


def with_fields(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(k, t) for k, t in more.items())])


def arrow_type(df_schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(a.split()[0], kinds[a.split()[1]]) for a in df_schema.split(", ")])


def batch(schema: str, **columns) -> pa.RecordBatch:
    """A record batch from Python or numpy columns, in the order and types of schema."""
    s = arrow_type(schema)
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in s], schema=s)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Lists of the named columns, batch by batch."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)
