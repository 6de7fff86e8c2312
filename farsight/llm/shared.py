"""Small helpers that every operator of this subpackage uses: inputs, the shared folder and written tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.sources.shared import shared_base


#: Tables that written() made in the innermost scratch().
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


#: Rows and bytes of an Arrow batch of texts.
_BATCH = {"maxRecordsPerBatch": 1000, "maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in small batches: those of 10,000 rows stand in the executor's and the worker's memory, which both keep."""
    for name, most in _BATCH.items():
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:  # 0: no limit
            spark.conf.set(key, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share."""
    return f"{shared_base(spark)}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back: its lineage ends there, and a lost executor costs no recomputation.

    The files go with removed(), at the end of scratch(), or else when the session ends. Shuffle files that nothing
    refers to any more go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    schema = df.schema
    del df
    # Spark removes shuffle files when the driver's garbage is collected; what the first round frees holds more
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table.written_at = where
    if (made := _MADE.get()) is not None:
        made.append(table)
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more. Once deleted, a table is passed over."""
    for table in tables:
        where = table.written_at
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block at whose end the tables go that were written() in it; the function given is a written() for what outlives it.

    What leaves the block must read no other table of the block.
    """
    outer = _MADE.get()
    token = _MADE.set(made := [])

    def kept(df: DataFrame, name: str) -> DataFrame:
        inner = _MADE.set(outer)
        try:
            return written(df, name)
        finally:
            _MADE.reset(inner)

    try:
        yield kept
    finally:
        _MADE.reset(token)
        removed(*made)


def text_or_empty(col: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
