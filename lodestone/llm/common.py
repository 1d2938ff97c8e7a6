"""Helpers shared by the training-data operators: table access, Arrow text views, shared folders."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.folders import shared_folder

#: Bytes of text that the numpy operators hold at once, besides a single longer text.
BLOCK_BYTES = 1 << 20
#: Words of 64 bits in a sieve: at most so many rows are broadcast, however many keys there are.
SIEVE = 1 << 19
#: glibc's call that gives freed memory back to the system, where there is one: idle Python workers then hold little.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, also for checkpoints; on a cluster it must be set."""
    path = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder (at path, where it is given) and read back: cuts lineage, survives lost executors."""
    path = path or shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more, and lets the driver's cleaner drop the shuffle files of finished jobs."""
    for path in paths:
        delete_path(spark, path)
    spark.sparkContext._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _spot(key: Column) -> tuple[Column, Column]:
    """The word of a sieve that a 64-bit hash falls to, and its bit there."""
    at = F.pmod(key, F.lit(64 * SIEVE))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))


def sieve(keys: DataFrame, key: Column, **marks: Column) -> DataFrame:
    """(word, a column of bits for each mark): a table of bounded size that holds the hashes of the keys with that mark."""
    word, bit = _spot(key)
    return keys.groupBy(word.alias("word")).agg(*(F.bit_or(F.when(on, bit).otherwise(F.lit(0).cast("long"))).alias(name) for name, on in marks.items()))


def sifted(df: DataFrame, table: DataFrame, key: Column) -> DataFrame:
    """df with a flag for each mark of the sieve: false where surely no key of that mark is the row's, so no join is needed; true may err."""
    word, bit = _spot(key)
    flags = [F.coalesce(F.col(c).bitwiseAND(bit) != 0, F.lit(False)).alias(c) for c in table.columns if c != "word"]
    return df.withColumn("word", word).join(F.broadcast(table), "word", "left").select(*df.columns, *flags)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores until no column has it; Spark's names don't tell cases apart."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow for any column names: run sees those that aren't plain words by their number."""
    names = [c if c.isidentifier() else free_name(f"_{i}", df.columns) for i, c in enumerate(df.columns)]
    return df.toDF(*names).mapInArrow(run, schema)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column with nulls as empty strings."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, zero-copy, and the len + 1 offsets into them."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes of text, or of one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    low, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > low and held + n > limit:
            yield low, i
            low, held = i, 0
        held += n
    if len(sizes) > low:
        yield low, len(sizes)


def arrow_blocks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BLOCK_BYTES, trim: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut anew by bytes of text; with trim freed memory goes back to the system at the end."""
    for batch in batches:
        for low, high in row_blocks(batch.column(batch.schema.get_field_index(name)), limit):
            yield batch.slice(low, high - low)
    if trim and _TRIM:
        _TRIM(0)
