"""What the operators of this subpackage share: reading tables, words, shared checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegralType, StringType

#: A word is a run of anything but space, tab, LF, VT, FF and CR. bytes.split() splits on just these.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    """The column as a string, nulls as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="kelpie-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: cuts lineage, is computed once, and outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in a broadcast table."""

    def of(c: Column, t: DataType) -> Column:
        if isinstance(t, StringType | BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(t, ArrayType):
            each = F.lit(8) if not isinstance(t.elementType, StringType) else F.lit(32)
            return F.coalesce(F.size(c), F.lit(0)) * each + 16
        return F.lit(8)

    total = F.lit(48)
    for f in df.schema.fields:
        total = total + of(F.col(f"`{f.name}`"), f.dataType)
    return total.cast("long")


def sized(df: DataFrame, most_bytes: int) -> DataFrame:
    """A computed (cut) table, to be broadcast if its rows take at most that many bytes; beyond, Spark joins by a shuffle."""
    measured = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if measured <= most_bytes else df


def shards_for(df: DataFrame) -> int:
    """Into how many shards what is gathered from a table is dealt: spark.sql.shuffle.partitions, fewer for a table of fewer partitions."""
    spark = df.sparkSession
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long; an id that is no integer is an error."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} has to be an integer, not {kind.simpleString()}")
    return F.col(id_col).cast("long")


def order_key(docs: DataFrame, id_col: str) -> Column:
    """A long that orders documents: the id where it is an integer, else its hash; the least long stands for null."""
    own = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    return F.coalesce(own, F.lit(-(1 << 63)))


CODEC = pa.Codec("zstd", 1)


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + (CODEC.compress(planes.tobytes(), asbytes=True) if len(values) else b"")


def unpack(block: bytes, kind: str = "<i8") -> np.ndarray:
    n, size = int.from_bytes(block[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(CODEC.decompress(block[8:], n * size, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(block: bytes) -> np.ndarray:
    return np.cumsum(unpack(block))


def map_rows(df: DataFrame, schema: str, rows: Callable[[dict], Iterator[tuple]], max_rows: int = 4096) -> DataFrame:
    """A map over Arrow batches: rows() gets a batch's columns as lists and yields output tuples.

    Output goes out in batches of max_rows, so a batch that expands does not pile up in memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pending = []
            for row in rows(batch.to_pydict()):
                pending.append(row)
                if len(pending) >= max_rows:
                    yield to_batch(pending, out_schema)
                    pending = []
            if pending:
                yield to_batch(pending, out_schema)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
