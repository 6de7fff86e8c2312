"""Filtered vector top-k, in bounded blocks of query vectors, and the retrieval strategies built on it.

A scan compares its rows with a block of queries and keeps the k nearest of each task for each query; only these reach
the shuffle, where a window ranks them. Matrix products bound the distances, and only rows within the bound of a query's
k-th so far are measured one by one. Ties go to the smaller id everywhere. Filters are plain Spark conditions below the
scan, so they and the two columns needed are pushed into the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.functions.vectors import batch_distances, distance, near_distances, paired_distances

#: Query vectors that are broadcast with one scan, those that are compared with a batch at once, and the most rows kept for all of a block.
BLOCK, TILE, KEPT = 4096, 256, 1 << 20
#: Rows of a task where there are more queries than a tile.
TASK_ROWS = 1 << 17
FOUND = "query_id long, vec_id long, distance double, passes boolean"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64()), ("passes", pa.bool_())])


def query_blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of blocks of queries (query_id, qvec), by rank of their hash, each collected on its own."""
    n = queries.count()
    parts = -(-n // size)
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).orderBy("query_id").collect()
        if rows:
            ids, vectors = np.array([r["query_id"] for r in rows], np.int64), [r["qvec"] for r in rows]
            if len({len(v) for v in vectors}) > 1:
                raise ValueError("query vectors of different sizes")
            vectors = np.array(vectors, np.float64)
            if not np.isfinite(vectors).all():
                raise ValueError("query vectors must be finite")
            yield ids, vectors


def matrix(v: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles; null elements become NaN."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = np.unique(v.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} elements")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


class Nearest:
    """The k nearest of all rows added so far for each query of a block; the memory goes with the queries and k, not with the rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str):
        self.ids, self.vectors, self.k, self.metric = ids, vectors, k, metric
        # by tile: position of the query, distance, id and flag, sorted by the first three; and the k-th distance of each query
        self.kept = {a: (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, bool)) for a in range(0, len(ids), TILE)}
        self.last = np.full(len(ids), np.inf)

    def add(self, x: np.ndarray, own: np.ndarray, ok: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Rows (vectors x, ids own, flags ok), compared with the queries that `asked` marks, or all."""
        if x.shape[1] != self.vectors.shape[1]:
            raise ValueError(f"vectors of {x.shape[1]} and of {self.vectors.shape[1]} elements")
        for a in self.kept:
            some = slice(a, min(a + TILE, len(self.ids)))
            if len(x) and (asked is None or asked[some].any()):
                self._add(a, some, x, own, ok, None if asked is None else asked[some])

    def _add(self, a: int, some: slice, x: np.ndarray, own: np.ndarray, ok: np.ndarray, asked: np.ndarray | None) -> None:
        v, last = self.vectors[some], self.last[some]
        near, limit, slack = near_distances(x, v, last, self.metric)
        if len(x) > self.k and np.isinf(last).any():
            limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
        if asked is not None:
            limit = np.where(asked, limit, -np.inf)
        q, r = np.nonzero(near <= limit[:, None])
        if not len(q):
            return
        d = np.concatenate([paired_distances(x[r[i : i + 32768]], v[q[i : i + 32768]], self.metric) for i in range(0, len(q), 32768)])
        can = ~(d > last[q])
        kept = self.kept[a]
        q, d, i, p = (np.concatenate(c) for c in zip(kept, (q[can], d[can], own[r[can]], ok[r[can]]), strict=True))
        order = np.lexsort((i, d, q))
        sizes = np.bincount(q, minlength=len(v))
        order = order[np.arange(len(q)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < self.k]
        self.kept[a] = q, d, i, p = q[order], d[order], i[order], p[order]
        ends = np.cumsum(np.minimum(sizes, self.k)) - 1
        self.last[some] = np.where((sizes >= self.k) & ~np.isnan(d[ends]), d[ends], np.inf)

    def found(self) -> Iterator[pa.RecordBatch]:
        """The rows kept, with the id of their query, tile by tile."""
        for a, (q, d, i, p) in self.kept.items():
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[a + q]), pa.array(i), pa.array(d, from_pandas=False), pa.array(p)], schema=_FOUND)


def ranked_top_k(spark, found: list[DataFrame], k: int) -> DataFrame:
    """The k nearest for each query among the results of blocks and batches, in one form for no blocks too."""
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double, passes boolean")
    best = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "distance", "passes")


def _spread(rows: DataFrame, n_queries: int, blocks: int) -> DataFrame:
    """Rows dealt to tasks anew where there are many queries: the files alone may be one task, however long that takes."""
    if n_queries <= TILE:
        return rows
    parts = max(-(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks), -(-rows.count() // TASK_ROWS))
    return rows.repartition(parts, "vec_id")


def top_k(base: DataFrame, queries: DataFrame, k: int, *, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", passes: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, distance, passes): the k nearest rows of `base` for each query; rank counts from 1.

    `passes` is a condition carried along, not applied. Rows without a vector are never found.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = base.sparkSession
    rows = base.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.coalesce(F.lit(True) if passes is None else passes, F.lit(False)).alias("passes"))

    def nearest(held):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = Nearest(*held.value, k, metric)
            for batch in it:
                if batch.num_rows:
                    kept.add(matrix(batch.column("v")), batch.column("vec_id").to_numpy(), batch.column("passes").to_numpy(zero_copy_only=False))
            yield from kept.found()

        return batches

    blocks = [spark.sparkContext.broadcast(b) for b in query_blocks(queries, min(block, max(1, KEPT // k)))]
    rows = _spread(rows, sum(len(b.value[0]) for b in blocks), len(blocks))
    return ranked_top_k(spark, [rows.mapInArrow(nearest(b), FOUND) for b in blocks], k)


def nearest_query(base: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, least): the L2 distance of each row to its nearest query, inside the scan: no join, and no shuffle for one block of queries."""
    rows = base.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))

    def nearest(held):
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, vectors = held.value
            for batch in it:
                x = np.stack(batch["v"].to_numpy()).astype(np.float64) if len(batch) else np.empty((0, vectors.shape[1]))
                least = np.full(len(batch), np.inf)
                for v in vectors:
                    least = np.minimum(least, batch_distances(x, v, "l2"))
                yield pd.DataFrame({"vec_id": batch["vec_id"], "least": least})

        return batches

    found = [rows.mapInPandas(nearest(base.sparkSession.sparkContext.broadcast(b)), "vec_id long, least double") for b in query_blocks(queries, block)]
    if len(found) == 1:
        return found[0]
    every = reduce(DataFrame.unionAll, found) if found else base.sparkSession.createDataFrame([], "vec_id long, least double")
    return every.groupBy("vec_id").agg(F.min("least").alias("least"))


def nearest_to(base: DataFrame, query: list[float], k: int, *, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """(vec_id, distance) for one query vector, in expressions only: filter, project, take ordered."""
    qvec = F.array(*(F.lit(float(x)) for x in query))
    rows = base.where(F.col(vec_col).isNotNull() & (F.lit(True) if where is None else where))
    return rows.select(F.col(id_col).alias("vec_id"), distance(metric, F.col(vec_col), qvec).alias("distance")).orderBy(F.asc_nulls_last("distance"), "vec_id").limit(k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query by their old rank, ranked anew."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def exact(base: DataFrame, queries: DataFrame, k: int, passes: Column, **options) -> DataFrame:
    """Filter first, then the k nearest: the truth."""
    return top_k(base.where(passes), queries, k, **options).drop("passes")


def postfilter(base: DataFrame, queries: DataFrame, k: int, passes: Column, *, ef: int = 40, **options) -> DataFrame:
    """The k first rows that pass among the `ef` nearest of all rows; may give fewer."""
    return _ranked(top_k(base, queries, ef, passes=passes, **options).where("passes"), k)


def iterative(base: DataFrame, queries: DataFrame, k: int, passes: Column, *, ef: int = 40, max_scan: int = 5000, **options) -> DataFrame:
    """As postfilter, on a frontier that doubles for the queries still short of k, up to `max_scan` rows."""
    size, done, open_ = min(ef, max_scan), None, queries
    while True:
        # kept, as it is counted and then given out: at most k rows for each query
        found = _ranked(top_k(base, open_, size, passes=passes, **options).where("passes"), k).persist()
        if size >= max_scan:
            return found if done is None else done.unionAll(found)
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        kept = found.join(full, "query_id", "left_semi").select(found.columns)
        done = kept if done is None else done.unionAll(kept)
        open_ = open_.join(full, "query_id", "left_anti")
        if open_.isEmpty():
            return done
        size = min(2 * size, max_scan)
