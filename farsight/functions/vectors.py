"""Distances between array columns, as expressions that Catalyst plans (no UDF), and NumPy kernels for Arrow batches.

Smaller is nearer for every metric: the inner product comes with its sign turned. Norms are held above 1e-12, so a
zero vector has cosine distance 1. Arrays of different sizes raise an error instead of giving null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine", "l1")
#: SQL operators of vector databases for these metrics, and for the bit metrics. Fixed values.
OPERATORS = {"<->": "l2", "<#>": "ip", "<=>": "cosine", "<+>": "l1", "<~>": "hamming", "<%>": "jaccard"}
_LEAST_NORM = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _paired(a: Column | str, b: Column | str, of) -> Column:
    """The sum of `of` over the pairs of elements, in double precision."""
    a, b = _c(a), _c(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: of(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).when(a.isNull() | b.isNull(), None).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))


def l2_squared(a, b) -> Column:
    return _paired(a, b, lambda x, y: (x - y) * (x - y))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def inner_product(a, b) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def negative_inner_product(a, b) -> Column:
    return -inner_product(a, b)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    return 1 - inner_product(a, b) / (F.greatest(norm(a), F.lit(_LEAST_NORM)) * F.greatest(norm(b), F.lit(_LEAST_NORM)))


def l1(a, b) -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y))


def hamming(a, b) -> Column:
    """Differing bits of two bigint columns."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def jaccard(a, b) -> Column:
    """One less the share of common bits of two bigint columns; 0 for two zeros."""
    a, b = _c(a), _c(b)
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either == 0, 0.0).otherwise(1 - F.bit_count(a.bitwiseAND(b)) / either)


_BY_NAME = {"l2": l2, "ip": negative_inner_product, "cosine": cosine, "l1": l1}


def distance(metric: str, a, b) -> Column:
    """The distance of two array columns by a metric's name."""
    if metric not in _BY_NAME:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return _BY_NAME[metric](a, b)


#: The distances as SQL functions: name, type of both parameters, type of the result, body.
_PAIRED_SQL = "aggregate(zip_with(a, b, (x, y) -> {0}), 0D, (s, x) -> s + x)"
_NORM_SQL = "greatest(sqrt(aggregate({0}, 0D, (s, x) -> s + x * x)), 1e-12D)"
_SQL_FUNCTIONS = {
    "vector_l2": ("ARRAY<DOUBLE>", "DOUBLE", f"sqrt({_PAIRED_SQL.format('(x - y) * (x - y)')})"),
    "vector_l2_squared": ("ARRAY<DOUBLE>", "DOUBLE", _PAIRED_SQL.format("(x - y) * (x - y)")),
    "vector_inner_product": ("ARRAY<DOUBLE>", "DOUBLE", _PAIRED_SQL.format("x * y")),
    "vector_l1": ("ARRAY<DOUBLE>", "DOUBLE", _PAIRED_SQL.format("abs(x - y)")),
    "vector_cosine": ("ARRAY<DOUBLE>", "DOUBLE", f"1 - {_PAIRED_SQL.format('x * y')} / ({_NORM_SQL.format('a')} * {_NORM_SQL.format('b')})"),
    "bits_hamming": ("BIGINT", "INT", "bit_count(a ^ b)"),
    "bits_jaccard": ("BIGINT", "DOUBLE", "if(a | b = 0, 0D, 1 - bit_count(a & b) / bit_count(a | b))"),
}


def register(spark) -> list[str]:
    """The distances as temporary SQL functions of the session, by Spark's own SQL function bodies; returns their names."""
    for name, (of, gives, body) in _SQL_FUNCTIONS.items():
        if of.startswith("ARRAY"):
            body = f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) <> size(b) THEN CAST(raise_error('vectors of different sizes') AS DOUBLE) ELSE {body} END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a {of}, b {of}) RETURNS {gives} RETURN {body}")
    return list(_SQL_FUNCTIONS)


def batch_distances(base: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of `base` to one query, in double precision."""
    if metric == "l2":
        return np.sqrt(((base - query) ** 2).sum(axis=1))
    if metric == "ip":
        return -(base @ query)
    if metric == "l1":
        return np.abs(base - query).sum(axis=1)
    if metric == "cosine":
        norms = np.maximum(np.sqrt((base**2).sum(axis=1)), _LEAST_NORM) * max(float(np.sqrt((query**2).sum())), _LEAST_NORM)
        return 1 - (base @ query) / norms
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def paired_distances(x: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of x to the rows of v, one by one, in double precision: equal rows give equal distances wherever they stand."""
    if metric == "l2":
        return np.sqrt(((x - v) ** 2).sum(axis=1))
    if metric == "ip":
        return -(x * v).sum(axis=1)
    if metric == "l1":
        return np.abs(x - v).sum(axis=1)
    if metric == "cosine":
        norms = [np.maximum(np.sqrt((a**2).sum(axis=1)), _LEAST_NORM) for a in (x, v)]
        return 1 - (x * v).sum(axis=1) / (norms[0] * norms[1])
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


#: What rounding may do to a distance from a matrix product, as a share of the squared norms that it is made of.
_ROUNDING = 1e-10


def near_distances(x: np.ndarray, v: np.ndarray, last: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearly the distances of each of v (rows) to each of x (columns), or what orders as they do; what `last` is on that scale, made
    so large that no row within that distance lies above it; and the most that a value may be off. Rows that aren't finite are infinitely far."""
    squares, own = (x**2).sum(axis=1), (v**2).sum(axis=1)
    finite = np.isfinite(squares)
    if metric == "l1":
        near = np.stack([np.abs(x - q).sum(axis=1) for q in v])
        slack, limit = np.zeros(len(v)), last
    else:
        most = squares[finite].max(initial=0.0)
        near = v @ x.T
        if metric == "l2":
            near *= -2
            near += squares
            near += own[:, None]
            slack = _ROUNDING * (own + most)
            limit = last**2 + slack
        elif metric == "ip":
            near *= -1
            slack = _ROUNDING * (own + most)
            limit = last + slack
        elif metric == "cosine":
            near /= np.maximum(np.sqrt(squares), _LEAST_NORM)
            near /= -np.maximum(np.sqrt(own), _LEAST_NORM)[:, None]
            near += 1
            slack = np.full(len(v), _ROUNDING)
            limit = last + slack
        else:
            raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    near[:, ~finite] = np.inf
    return near, limit, slack
