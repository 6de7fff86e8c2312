"""Vectors and query vectors from arrays on disk, SQL, samples and a seeded generator."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_QUERIES = 64


def parse_vector(text: str, dim: int | None = None) -> list[float]:
    """One vector from a JSON array or from numbers apart by commas or blanks; finite, of `dim` elements if given."""
    text = text.strip()
    values = json.loads(text) if text.startswith("[") else [float(x) for x in text.replace(",", " ").split()]
    if not values or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in values):
        raise ValueError("a vector is a list of finite numbers")
    if dim is not None and len(values) != dim:
        raise ValueError(f"a vector of {len(values)} elements, not {dim}")
    return [float(x) for x in values]


def parse_vectors(text: str, most: int = MOST_QUERIES, dim: int | None = None) -> list[list[float]]:
    """Up to `most` vectors from a JSON array of arrays, {"vectors": [...]}, or one vector a line with # comments."""
    stripped = text.strip()
    if stripped.startswith("{"):
        rows = json.loads(stripped)["vectors"]
    elif stripped.startswith("[["):
        rows = json.loads(stripped)
    else:
        rows = [x for x in (line.split("#")[0].strip() for line in stripped.splitlines()) if x]
    return [parse_vector(x if isinstance(x, str) else json.dumps(x), dim) for x in rows[:most]]


def queries_of(spark: SparkSession, vectors: list[list[float]]) -> DataFrame:
    """(query_id, qvec) from vectors on the driver."""
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, qvec array<double>")


def queries_from_file(spark: SparkSession, path: str, most: int = MOST_QUERIES, dim: int | None = None) -> DataFrame:
    """Query vectors from a .npy, JSON or text file."""
    if path.endswith(".npy"):
        found = np.atleast_2d(np.load(path))[:most]
        return queries_of(spark, [parse_vector(json.dumps(row.tolist()), dim) for row in found])
    return queries_of(spark, parse_vectors(Path(path).read_text(), most, dim))


def queries_from_sql(spark: SparkSession, query: str, most: int = MOST_QUERIES) -> DataFrame:
    """Query vectors from a SELECT of one array column."""
    if not query.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT and WITH are read")
    found = spark.sql(query)
    if len(found.columns) != 1:
        raise ValueError("one column is needed")
    rows = found.where(F.col(found.columns[0]).isNotNull()).limit(most).collect()
    return queries_of(spark, [list(map(float, r[0])) for r in rows])


def sample_fraction(n_rows: int, most: int) -> float:
    """All of a small table, else twenty times what is needed."""
    return 1.0 if n_rows <= 100 * most else min(1.0, max(1e-4, 20 * most / n_rows))


def queries_from_sample(base: DataFrame, most: int = MOST_QUERIES, *, vec_col: str = "embedding", seed: int = 1) -> DataFrame:
    """Query vectors sampled from a table: a sampling operator, so at most `most` of them."""
    rows = base.where(F.col(vec_col).isNotNull())
    picked = rows.sample(sample_fraction(rows.count(), most), seed).select(vec_col).limit(most).collect()
    return queries_of(base.sparkSession, [list(map(float, r[0])) for r in picked])


def vectors_from_npy(spark: SparkSession, path: str, mask_path: str | None = None) -> DataFrame:
    """(vec_id, embedding, passes_filter) from a 2-D .npy and a 1-D mask; tasks read their own rows of the mapped file."""
    shape = np.load(path, mmap_mode="r").shape
    if len(shape) != 2:
        raise ValueError("vectors are a 2-D array")
    if mask_path is not None and np.load(mask_path, mmap_mode="r").shape != shape[:1]:
        raise ValueError("the mask has another length")

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.load(path, mmap_mode="r")
        mask = np.load(mask_path, mmap_mode="r") if mask_path else None
        for batch in it:
            ids = batch["id"].to_numpy()
            yield pd.DataFrame({"vec_id": ids, "embedding": list(np.asarray(data[ids], np.float32)), "passes_filter": np.asarray(mask[ids], bool) if mask is not None else True})

    return spark.range(shape[0]).mapInPandas(rows, "vec_id long, embedding array<float>, passes_filter boolean")


def cluster_chances(clusters: int, selectivity: float, correlation: float) -> np.ndarray:
    """The chance to pass by cluster: weights fall from the first cluster on as the correlation grows; their mean is the selectivity."""
    weights = np.exp(4 * abs(correlation) * np.linspace(1, -1, clusters)) if clusters > 1 else np.ones(1)
    if correlation < 0:
        weights = weights[::-1]
    low, high = 0.0, 1.0 / weights.min()
    for _ in range(64):
        middle = (low + high) / 2
        low, high = (middle, high) if np.minimum(1, middle * weights).mean() < selectivity else (low, middle)
    return np.minimum(1, high * weights)


def clustered(spark: SparkSession, n: int, dim: int, *, clusters: int = 16, selectivity: float = 0.05, correlation: float = 0.0, spread: float = 0.08, seed: int = 42) -> DataFrame:
    """(vec_id, cluster_id, passes_filter, embedding): noisy points around unit centres; each row follows from its id and the seed."""
    centres = np.random.default_rng(seed).normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    chances = cluster_chances(clusters, selectivity, correlation)

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).to_numpy()
            rows = [np.random.default_rng((seed, int(i))) for i in ids]
            of = np.array([r.integers(clusters) for r in rows])
            passes = np.array([r.random() for r in rows]) < chances[of]
            vectors = (centres[of] + spread * np.stack([r.normal(size=dim) for r in rows])).astype(np.float32) if len(ids) else np.empty((0, dim), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * dim + 1, dim, dtype=np.int32)), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(of.astype(np.int32)), pa.array(passes), lists], names=["vec_id", "cluster_id", "passes_filter", "embedding"])

    return spark.range(n).mapInArrow(made, "vec_id long, cluster_id int, passes_filter boolean, embedding array<float>")


def clustered_queries(spark: SparkSession, n: int, dim: int, *, clusters: int = 16, selectivity: float = 0.05, correlation: float = 0.0, policy: str = "uniform", spread: float = 0.04, seed: int = 42) -> DataFrame:
    """(query_id, qvec) around the centres of `clustered`; policy uniform, filter_hot or filter_cold chooses the clusters."""
    centres = np.random.default_rng(seed).normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    chances = cluster_chances(clusters, selectivity, correlation)
    weights = {"uniform": np.ones(clusters), "filter_hot": chances, "filter_cold": 1 - chances}[policy]
    weights = weights / weights.sum() if weights.sum() else np.full(clusters, 1 / clusters)
    r = np.random.default_rng(seed + 1)
    of = r.choice(clusters, n, p=weights)
    return queries_of(spark, (centres[of] + spread * r.normal(size=(n, dim))).tolist())
