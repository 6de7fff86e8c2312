"""Iterative filtered search that can be resumed: a kept frontier, and rounds that read only what can still matter.

The strategy returns the first k rows that pass among the `max_scan` nearest of all rows. Each round, every open query
reads the next shelves in the order of their lower bounds and merges them into its frontier, its `max_scan` nearest rows so far.
A shelf whose bound lies beyond the k-th passing row, or beyond the last of a full frontier, can change nothing: a query
without another shelf within that is done. No query reads a shelf twice; what a round read is returned beside the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.operators.search import TILE, Nearest, matrix
from farsight.sources.shelves import Shelves, asked, routed

#: Shelves of each query in the first round, and how many times more each further round takes.
FIRST, GROWTH = 8, 4


@dataclass(frozen=True)
class Scan:
    """found: (query_id, rank, vec_id, distance); reads: (round, query_id, shelf), each pair of query and shelf once; rounds: their number."""

    found: DataFrame
    reads: DataFrame
    rounds: int


def ahead(take: int):
    """Picks the next `take` shelves of each of queries (bound, done: how many it has read), those within its bound."""

    def pick(known: Shelves, gaps: np.ndarray, some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        least = known.bounds(gaps)
        order = np.argsort(least, axis=1, kind="stable")
        place = np.arange(order.shape[1]) - some.column("done").to_numpy()[:, None]
        bound = some.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False)
        i, at = np.nonzero((place >= 0) & (place < take) & (np.take_along_axis(least, order, axis=1) <= bound[:, None]))
        return i, order[i, at]

    return pick


def nearest_in_shelf(x: np.ndarray, ids: np.ndarray, ok: np.ndarray, asks: pa.RecordBatch, most: int) -> Iterator[pd.DataFrame]:
    """The `most` nearest rows of a shelf within the bound of each ask, if it has one; a tile of asks at a time."""
    for a in range(0, asks.num_rows, TILE):
        some = asks.slice(a, TILE)
        kept = Nearest(some.column("query_id").to_numpy(), matrix(some.column("qvec")), most, "l2")
        kept.last = np.array(some.column("bound").fill_null(np.inf))
        kept.add(x, ids, ok)
        for found in kept.found():
            yield found.to_pandas()


def _merge(rows: DataFrame, k: int, max_scan: int) -> DataFrame:
    """The nearest `max_scan` rows of each query, with their place and the rank of those that pass."""
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    placed = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_scan)
    return placed.withColumn("rank", F.when(F.col("passes"), F.count_if("passes").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))


def iterative_scan(shelves: Shelves, queries: DataFrame, k: int, passes: Column, folder: str, *, max_scan: int = 5000, first: int = FIRST, growth: int = GROWTH, id_col: str = "vec_id") -> Scan:
    """The first k rows that pass among the `max_scan` nearest by L2 of each of queries (query_id, qvec); rounds are written to `folder`."""
    if k < 1 or max_scan < 1:
        raise ValueError("k and max_scan must be positive")
    spark = queries.sparkSession
    flagged = Shelves(shelves.rows.withColumn("passes_", F.coalesce(passes, F.lit(False))), *(getattr(shelves, c) for c in ("centres", "number", "centre", "low", "high", "size")))

    def written(df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{folder}/{name}", df.schema
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)

    def nearest(rows: dict, asks: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        return nearest_in_shelf(rows["x"], rows[id_col].to_numpy(), rows["passes_"].to_numpy(zero_copy_only=False), asks, max_scan)

    start = written(queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")), "queries")
    state = start.select("*", F.lit(None).cast("double").alias("bound"), F.lit(0).cast("long").alias("done"))
    frontier, reads = None, []
    for number in count():
        asks = written(routed(shelves, state, ahead(first * growth**number)), f"asks-{number}")
        if asks.isEmpty():
            break
        reads.append(asks.select(F.lit(number).alias("round"), "query_id", "shelf"))
        hits = asked(flagged, asks.select("shelf", "query_id", "qvec", "bound"), [id_col, "passes_"], nearest, "query_id long, vec_id long, distance double, passes boolean")
        if frontier is not None:
            hits = frontier.select("query_id", "vec_id", "distance", "passes").unionAll(hits)
        frontier = written(_merge(hits, k, max_scan), f"frontier-{number}")
        within = F.least(F.min(F.when(F.col("rank") == k, F.col("distance"))), F.min(F.when(F.col("place") == max_scan, F.col("distance"))))
        passed = asks.groupBy("query_id").agg((F.max("done") + F.count("*")).alias("done"))  # a query that asked for nothing is done
        bounds = frontier.groupBy("query_id").agg(F.nanvl(within, F.lit(None).cast("double")).alias("bound"))
        state = start.join(passed, "query_id").join(bounds, "query_id", "left").select("query_id", "qvec", "bound", "done")
    if frontier is None:
        return Scan(spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double"), spark.createDataFrame([], "round int, query_id long, shelf long"), 0)
    return Scan(frontier.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance"), reduce(DataFrame.unionAll, reads), len(reads))
