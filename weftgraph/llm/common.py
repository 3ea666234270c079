"""Shared plumbing of the corpus operators: inputs, checkpoints, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LIBC = ctypes.CDLL(None)

#: Texts are handled in groups of about this many bytes, so that a worker's memory does not follow the batch.
GROUP_BYTES = 1 << 20


#: Rows and bytes of an Arrow batch, at most: long texts must fit in a worker by the batch.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def modest_batches(spark: SparkSession) -> None:
    """See to it that the session hands texts to Python in modest batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``; only where none is set and all runs on one machine, a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that live as long as a computation needs them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.number = spark, os.path.join(set_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}"), 0

    def write(self, df: DataFrame, *by: str, compression: str = "none") -> DataFrame:
        """The rows of ``df``, written, in folders by the columns ``by``, and read again; its shuffle files go when they are written. Columns that are compressed already need no more of it."""
        self.number += 1
        path = f"{self.root}/{self.number}.parquet"
        with shuffles_dropped(self.spark):
            df.write.partitionBy(*by).option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, table: DataFrame | None = None, part: str = "") -> None:
        """Remove a table, or one folder of it, or all there is."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{table.scratch_path}/{part}" if table else self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs in here are removed as soon as it has ended; what it wrote is in the shared folder by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields, whatever the names of its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shielded(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of the taken names, if it has any, renamed; and its columns, in order and under their names, to select in the end."""
    marks = {c: f"{c} of docs {uuid.uuid4().hex}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(marks), [F.col(quoted(marks.get(c, c))).alias(c) for c in docs.columns]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Values of a string or binary column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(sizes: list[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows whose sizes sum to about ``limit``; a larger row stands alone."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def tidy() -> None:
    """Give freed memory back: a worker that waits for its next task should hold no more than it needs."""
    gc.collect(1)
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidily(fn: Callable) -> Callable:
    """The same function of batches or of groups, tidied up after each task or group."""

    def run(first, *rest, **options):
        if isinstance(first, Iterator):
            return over(first, *rest, **options)
        try:
            return fn(first, *rest, **options)
        finally:
            tidy()

    def over(batches, *rest, **options):
        try:
            yield from fn(batches, *rest, **options)
        finally:
            tidy()

    return run


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return arrow_map(df, run, schema)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` of tables with any column names: it takes dots and backticks for more than a name."""
    names = df.columns
    if not any("`" in c or "." in c for c in names):
        return df.mapInArrow(tidily(fn), schema)
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.mapInArrow(tidily(lambda batches: fn(b.rename_columns(names) for b in batches)), schema)


def crc_mod(col, mod: int):
    """crc32 of an id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod
