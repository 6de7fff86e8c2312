"""Vectors sorted by their nearest centre and the gap to it, cut into shelves of bounded size.

A shelf knows its centre and the least and largest gap of its rows; by the triangle inequality no row of it can be
nearer to a query than the query's own gap to the centre lies outside these two. Only this directory, of a bounded number of
shelves, is held by the driver and broadcast; rows stay where they were written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.operators.search import matrix
from farsight.sources.layouts import fit_centres

#: Rows of a shelf, and the number of shelves from which on they become longer instead.
SHELF_ROWS, MOST_SHELVES = 2048, 1 << 17
#: The most cells of a matrix of vectors by centres or shelves, and the most asks in a batch: each ask holds a vector.
CELLS, ASKS = 1 << 18, 1 << 13
#: What rounding may add to a distance, as a share of the gaps it is made of.
SLACK = 1e-9


@dataclass(frozen=True)
class Shelves:
    """A written table of shelves (columns of the base, and list, gap, shelf) and its directory."""

    rows: DataFrame
    centres: np.ndarray
    number: np.ndarray
    centre: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    def gaps(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of vectors to every centre."""
        return np.stack([np.sqrt(((vectors - c) ** 2).sum(axis=1)) for c in self.centres], axis=1) if len(self.centres) else np.zeros((len(vectors), 0))

    def bounds(self, gaps: np.ndarray) -> np.ndarray:
        """The least possible distance of each query (by its gaps) to a row of each shelf."""
        own = gaps[:, self.centre]
        return np.maximum(0.0, np.maximum(self.low - own, own - self.high) - SLACK * (own + self.high))


def write_shelves(base: DataFrame, path: str, *, lists: int | None = None, shelf_rows: int = SHELF_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> Shelves:
    """All rows of `base` with a vector, sorted and cut. Without `lists`, so many that one holds about half a shelf, 4 to 1,024."""
    rows = base.where(F.col(vec_col).isNotNull())
    n = rows.count()
    shelf_rows = max(shelf_rows, -(-n // MOST_SHELVES))
    lists = lists or int(np.clip(2 * n // shelf_rows, 4, 1024))
    centres = fit_centres(rows, lists, vec_col=vec_col, seed=seed) if n else np.zeros((0, 1))
    held = base.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("list int, gap double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x, c = np.stack(v.to_numpy()).astype(np.float64), held.value
        step = max(1, CELLS // len(c))
        of = np.concatenate([((c**2).sum(axis=1) - 2 * x[a : a + step] @ c.T).argmin(axis=1) for a in range(0, len(x), step)])
        return pd.DataFrame({"list": of.astype(np.int32), "gap": np.sqrt(((x - c[of]) ** 2).sum(axis=1))})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, filled, before = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            of, numbers = batch.column("list").to_numpy(), np.empty(batch.num_rows, np.int64)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if before is not None and (of[a] != before):
                    shelf, filled = shelf + 1, 0
                steps = filled + np.arange(b - a)
                numbers[a:b] = shelf + steps // shelf_rows
                shelf, filled, before = shelf + (filled + b - a) // shelf_rows, (filled + b - a) % shelf_rows, of[a]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, "shelf"])

    placed = rows.withColumn("at_", nearest(vec_col)).select(*base.columns, "at_.list", "at_.gap")
    parts = max(1, n // (16 * shelf_rows))
    ordered = placed.repartitionByRange(parts, "list", "gap", id_col).sortWithinPartitions("list", "gap", id_col)
    schema = T.StructType([*placed.schema.fields, T.StructField("shelf", T.LongType())])
    ordered.mapInArrow(cut, schema).write.mode("overwrite").parquet(path)
    table = base.sparkSession.read.schema(schema).parquet(path)
    known = table.groupBy("shelf", "list").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("size")).orderBy("shelf").collect()  # bounded by MOST_SHELVES
    column = lambda c, kind: np.array([r[c] for r in known], kind)
    return Shelves(table, centres, column("shelf", np.int64), column("list", np.int64), column("low", float), column("high", float), column("size", np.int64))


def route(known: Shelves, queries: pa.RecordBatch, pick) -> Iterator[pa.RecordBatch]:
    """Asks of a batch of queries (qvec and others): shelf, and the query's columns, at most ASKS at once however many shelves there are.

    pick(known, gaps, some) gives the positions of queries within `some` and of the shelves that they ask, for a part of the queries with so
    many gaps and bounds as CELLS allows.
    """
    step = max(1, CELLS // max(1, len(known.number), len(known.centres)))
    for a in range(0, queries.num_rows if len(known.number) else 0, step):
        some = queries.slice(a, step)
        i, at = pick(known, known.gaps(matrix(some.column("qvec"))), some)
        for b in range(0, len(i), ASKS):
            own = pa.array(i[b : b + ASKS])
            yield pa.RecordBatch.from_arrays([pa.array(known.number[at[b : b + ASKS]]), *(c.take(own) for c in some.columns)], ["shelf", *some.schema.names])


def routed(shelves: Shelves, queries: DataFrame, pick) -> DataFrame:
    """The asks of all queries, as route() gives them."""
    held = queries.sparkSession.sparkContext.broadcast(Shelves(None, *(getattr(shelves, c) for c in ("centres", "number", "centre", "low", "high", "size"))))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from route(held.value, batch, pick)

    return queries.mapInArrow(batches, T.StructType([T.StructField("shelf", T.LongType()), *queries.schema.fields]))


def asked(shelves: Shelves, asks: DataFrame, columns: list[str], run, schema: str, *, vec_col: str = "embedding") -> DataFrame:
    """What `run(rows, asks)` yields for each shelf and a batch of its asks, as pandas frames of `schema`.

    asks: shelf, and columns of their own; rows: the vectors `x` of a shelf as a matrix, and `columns` of the table by name. A task holds one shelf
    at a time and streams the asks for it, however many they are; shelves that nobody asks for are not read on.
    """
    spark = asks.sparkSession
    wanted = shelves.rows.join(F.broadcast(asks.select("shelf").distinct()), "shelf", "left_semi")
    data = wanted.select("shelf", F.lit(0).alias("kind"), F.struct(F.col(vec_col).cast("array<double>").alias("v"), *columns).alias("row"), F.lit(None).cast(asks.drop("shelf").schema).alias("ask"))
    questions = asks.select("shelf", F.lit(1).alias("kind"), F.lit(None).cast(data.schema["row"].dataType).alias("row"), F.struct(*[c for c in asks.columns if c != "shelf"]).alias("ask"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, parts, rows = None, [], None
        for batch in batches:
            at, kind = batch.column("shelf").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if kind[a] == 0:
                    if shelf != at[a]:
                        shelf, parts, rows = at[a], [], None
                    parts.append(batch.column("row").slice(a, b - a))
                    continue
                if rows is None:
                    whole = pa.concat_arrays(parts)
                    v = whole.field("v") if whole.offset == 0 else pa.concat_arrays([whole.slice(0)]).field("v")
                    rows = {c: whole.field(c) for c in columns} | {"x": v.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)}
                    parts = []
                for found in run(rows, pa.RecordBatch.from_struct_array(batch.column("ask").slice(a, b - a))):
                    yield pa.RecordBatch.from_pandas(found, schema=arrow, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)
    return data.unionAll(questions).repartition(parts, "shelf").sortWithinPartitions("shelf", "kind").mapInArrow(stream, kinds)
