"""Copies of a vector table that searches can read instead of it: filtered, partitioned, and by nearest centre."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farsight.operators.search import BLOCK, FOUND, KEPT, Nearest, matrix, query_blocks, ranked_top_k
from farsight.plans.recommend import Layout


def write_filtered(base: DataFrame, passes: Column, path: str, predicates: tuple = ()) -> Layout:
    """Only the rows that pass, as their own table."""
    base.where(passes).write.mode("overwrite").parquet(path)
    return Layout(path, "filtered", tuple(predicates))


def write_partitioned(base: DataFrame, column: str, path: str) -> Layout:
    """The table in folders by a column of few values; a filter on it then reads only its folders.

    Rows are dealt by column and a hash of all, so that one common value is written by many tasks.
    """
    spread = F.pmod(F.xxhash64(*[c for c in base.columns if c != column]), F.lit(8))
    base.repartition(column, spread).write.mode("overwrite").partitionBy(column).parquet(path)
    return Layout(path, "partitioned", (), column)


def fit_centres(base: DataFrame, lists: int, *, vec_col: str = "embedding", most: int = 20000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means centres of at most `most` sampled vectors (a documented bound)."""
    rows = base.where(F.col(vec_col).isNotNull())
    n = rows.count()
    picked = rows.sample(min(1.0, 1.2 * most / max(1, n)), seed).select(vec_col).limit(most).collect()
    if not picked:
        return np.zeros((0, 1))
    x = np.array([r[0] for r in picked], np.float64)
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres


def write_by_centre(base: DataFrame, centres: np.ndarray, path: str, *, vec_col: str = "embedding") -> None:
    """Every row in the folder of its nearest centre."""
    held = base.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        c = held.value
        return pd.Series(((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1).astype(np.int32))

    rows = base.where(F.col(vec_col).isNotNull()).withColumn("list", nearest(vec_col))
    rows.repartition("list", F.pmod(F.xxhash64(vec_col), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(path)


def probes_for(m: int, lists: int, n_rows: int) -> int:
    """How many of `lists` lists over n_rows rows to probe so that they hold m rows: two at least where there are more and m > 1; the root of m where there are no lists."""
    if m < 1 or lists < 0 or n_rows < 0:
        raise ValueError("m must be positive, lists and rows not negative")
    if not lists:
        return math.isqrt(m - 1) + 1
    # m / (n_rows / lists), rounded up; empty lists count as one row
    needed = -(-m * lists // max(n_rows, lists))
    return min(lists, max(needed, 2 if lists > 1 and m > 1 else 1))


def search_by_centre(spark, path: str, centres: np.ndarray, queries: DataFrame, k: int, *, probes: int, passes: Column | None = None, metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """The k nearest within the `probes` lists nearest to each query: approximate.

    One scan for each block of queries; lists that none of them probes are pruned from it, and a batch is compared only
    with the queries that probe its list. Without queries there are no rows.
    """
    base = spark.read.parquet(path)
    ok = F.coalesce(F.lit(True) if passes is None else passes, F.lit(False))

    def nearest(held):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, probed = held.value
            kept = Nearest(ids, vectors, k, metric)
            for batch in it:
                lists, own = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy()
                x = matrix(batch.column("v"))
                for number in np.unique(lists):
                    some = lists == number
                    kept.add(x[some], own[some], np.ones(some.sum(), bool), probed[:, number])
            yield from kept.found()

        return batches

    found = []
    for ids, vectors in query_blocks(queries, min(block, max(1, KEPT // k))):
        far = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centres], axis=1)
        probed = np.zeros(far.shape, bool)
        np.put_along_axis(probed, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
        rows = base.where(F.col("list").isin(*np.flatnonzero(probed.any(axis=0)).tolist()) & ok)
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("list"))
        found.append(rows.mapInArrow(nearest(spark.sparkContext.broadcast((ids, vectors, probed))), FOUND))
    return ranked_top_k(spark, found, k)
