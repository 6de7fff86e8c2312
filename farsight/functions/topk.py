"""Top-k from SQL: `SELECT * FROM vector_topk(TABLE(SELECT vec_id, embedding, part FROM t) PARTITION BY (part), queries, k, metric)`.

A table function over the rows of one partition, for all query vectors at once: each partition keeps its k nearest for each query, in chunks of bounded size,
so what reaches the outer query is partitions x queries x k small rows. `top_k_sql` is the whole statement: partitions by a hash of the id, then
the ranks over what they kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from farsight.functions.vectors import METRICS, batch_distances

#: Rows that a partition holds before it keeps only the nearest of them.
CHUNK = 4096


RETURNS = "query_no int, vec_id long, distance double"


class _Nearest:
    """The k nearest rows met so far for each of some query vectors."""

    def __init__(self, queries, k: int, metric: str):
        if metric not in METRICS or k < 1:
            raise ValueError(f"metrics are {', '.join(METRICS)}, and k is positive")
        self.queries, self.k, self.metric = np.array(queries, np.float64).reshape(len(queries), -1), k, metric
        self.rows, self.ids = [], []
        self.best = [(np.empty(0), np.empty(0, np.int64)) for _ in self.queries]

    def add(self, row) -> None:
        if row["embedding"] is not None and row["vec_id"] is not None:
            self.rows.append(row["embedding"])
            self.ids.append(row["vec_id"])
            if len(self.rows) == CHUNK:
                self._keep()

    def _keep(self) -> None:
        x, ids = np.array(self.rows, np.float64), np.array(self.ids, np.int64)
        self.rows, self.ids = [], []
        if x.shape[1] != self.queries.shape[1]:
            raise ValueError(f"vectors of {x.shape[1]} and of {self.queries.shape[1]} elements")
        for i, (v, (held_d, held)) in enumerate(zip(self.queries, self.best, strict=True)):
            d, own = np.concatenate([held_d, batch_distances(x, v, self.metric)]), np.concatenate([held, ids])
            order = np.lexsort((own, d))[: self.k]
            self.best[i] = d[order], own[order]

    def found(self):
        if self.rows:
            self._keep()
        for i, (d, ids) in enumerate(self.best):
            for a, b in zip(d.tolist(), ids.tolist(), strict=True):
                yield i, b, a


@udtf(returnType=RETURNS)
class VectorTopK:
    """For a few query vectors, given as an argument (which SQL hands over with every row)."""

    def __init__(self):
        self.nearest = None

    def eval(self, row, queries, k, metric):
        if self.nearest is None:
            self.nearest = _Nearest(queries, k, metric)
        self.nearest.add(row)

    def terminate(self):
        if self.nearest is not None:
            yield from self.nearest.found()


def register_block(spark: SparkSession, name: str, vectors: np.ndarray, k: int, metric: str = "l2") -> None:
    """A table function of this name for a block of query vectors, which goes to each task once: `SELECT * FROM name(TABLE(...) PARTITION BY (part))`."""

    @udtf(returnType=RETURNS)
    class Block:
        def __init__(self):
            self.nearest = _Nearest(vectors, k, metric)

        def eval(self, row):
            self.nearest.add(row)

        def terminate(self):
            yield from self.nearest.found()

    spark.udtf.register(name, Block)


def register(spark: SparkSession) -> None:
    """Make `vector_topk` known to SQL."""
    spark.udtf.register("vector_topk", VectorTopK)


def top_k_sql(table: str, *, k: int, queries: str | None = None, function: str = "", where: str = "true", metric: str = "l2", parts: int = 32) -> str:
    """SQL for (query_no, rank, vec_id, distance) of a table with vec_id and embedding.

    The queries are SQL for an array of arrays of doubles, or those of a `function` made by register_block.
    """
    rows = f"SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS embedding, pmod(xxhash64(vec_id), {parts}) AS part FROM {table} WHERE {where}"
    call = f"vector_topk(TABLE({rows}) PARTITION BY (part), {queries}, {k}, '{metric}')" if queries else f"{function}(TABLE({rows}) PARTITION BY (part))"
    kept = f"SELECT * FROM {call}"
    return f"SELECT query_no, rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY distance, vec_id) AS rank FROM ({kept})) WHERE rank <= {k}"
