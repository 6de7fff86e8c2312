"""Facts of a Parquet table that need no scan: files, row counts, partition keys and bounds, from footers and file listings.

Row counts by file come from a scan of no columns, for which Spark reads only footers. Counts and bounds of columns are aggregates that
Spark's second Parquet reader answers from the statistics in the footers. Both run in tasks, over any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.operators.statistics import health

#: Types whose bounds Spark takes from footers.
_BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.BooleanType)


def partition_keys(spark: SparkSession, path: str) -> list[str]:
    """The columns that a table is in folders by, outermost first: those that no file holds."""
    relation = spark.read.parquet(path)._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation()
    fields = relation.partitionSchema().fields()
    return [f.name() for f in fields]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_size, modified, n_rows, and the partition keys) of each file that holds rows."""
    table, keys = spark.read.parquet(path), partition_keys(spark, path)
    meta = [F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time").alias("modified")]
    return table.select(*meta, *keys).groupBy("file_path", "file_size", "modified", *keys).agg(F.count("*").alias("n_rows"))


def relation_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_files, n_rows, n_bytes, modified (the latest)."""
    return files(spark, path).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"), F.max("modified").alias("modified"))


def _footers(spark: SparkSession, path: str) -> DataFrame:
    """The table through the reader that answers aggregates from footers, in a session of its own."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path)


def column_facts(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_values, low, high) of columns of numbers, dates and flags; low and high as text.

    NaN in a footer's column makes its bounds unknown to Parquet, and Spark then reads that file instead.
    """
    table = _footers(spark, path)
    kinds = {f.name: f.dataType for f in table.schema.fields}
    chosen = [c for c in (columns or kinds) if isinstance(kinds[c], _BOUNDED) and c not in partition_keys(spark, path)]
    if not chosen:
        return spark.createDataFrame([], "column_name string, n_rows long, n_values long, low string, high string")
    one = table.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{i}") for i, c in enumerate(chosen) for n, f in (("v", F.count), ("l", F.min), ("h", F.max))))
    part = lambda i, c: F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"v{i}").alias("n_values"), F.col(f"l{i}").cast("string").alias("low"), F.col(f"h{i}").cast("string").alias("high"))
    return one.select(F.inline(F.array(*(part(i, c) for i, c in enumerate(chosen)))))


def vector_dimension(table: DataFrame, column: str | None = None) -> int:
    """The number of elements of a column of vectors (the first one if not named), 0 where there are none; vectors of two sizes are an error."""
    arrays = [f.name for f in table.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))]
    if column is not None and column not in arrays:
        raise ValueError(f"no column of vectors is named {column}")
    if not arrays:
        return 0
    low, high = table.agg(F.min(F.size(column or arrays[0])), F.max(F.size(column or arrays[0]))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} elements")
    return high or 0


def changed_rows(snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """One row: snapshot_rows, current_rows, changed_rows, of two tables of files; a file that was rewritten counts on both sides."""
    both = snapshot.select("file_path", "file_size", "modified", F.col("n_rows").alias("old")).join(now.select("file_path", "file_size", "modified", F.col("n_rows").alias("new")), ["file_path", "file_size", "modified"], "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(total("old").alias("snapshot_rows"), total("new").alias("current_rows"), total(F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("old"))).alias("changed_rows"))


def freshness(snapshot: DataFrame | None, now: DataFrame) -> str:
    """fresh, stale or never_analyzed, by the rows of files that came, went or were rewritten since the snapshot of files."""
    if snapshot is None:
        return "never_analyzed"
    r = changed_rows(snapshot, now).first()
    return health(r["snapshot_rows"], r["current_rows"], r["changed_rows"])
