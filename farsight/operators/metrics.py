"""How good and how fast searches are: recall, returned rows, latencies. All inputs are long-form results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(truth: DataFrame, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, n_truth, n_found, hits, recall, returns_k) for every query; without true rows recall is 1."""
    t = truth.where(F.col("rank") <= k).select("query_id", "vec_id").distinct()
    f = found.where(F.col("rank") <= k).select("query_id", "vec_id").distinct()
    hits = f.join(t, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    counts = [x.groupBy("query_id").agg(F.count("*").alias(n)) for x, n in ((t, "n_truth"), (f, "n_found"))]
    out = queries.select("query_id").distinct()
    for part in (*counts, hits):
        out = out.join(part, "query_id", "left")
    out = out.fillna(0, ["n_truth", "n_found", "hits"])
    recall = F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("hits") / F.col("n_truth"))
    return out.withColumn("recall", recall).withColumn("returns_k", F.col("n_found") >= F.least("n_truth", F.lit(k)))


def summary(by_query: DataFrame) -> DataFrame:
    """One row: recall_at_k, returns_k_rate, mean_results."""
    return by_query.agg(
        F.avg("recall").alias("recall_at_k"), F.avg(F.col("returns_k").cast("double")).alias("returns_k_rate"), F.avg("n_found").alias("mean_results")
    )


def latency_summary(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """total, mean and exact, interpolated p50, p95 and p99 of a column, by group."""
    q = [F.percentile(value, F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return samples.groupBy(*by).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), *q)
