"""Local selectivity: the share of a query's nearest neighbours that pass a filter, against the global share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farsight.operators.search import top_k


def probes(base: DataFrame, queries: DataFrame, m: int, passes: Column, **options) -> DataFrame:
    """(query_id, sample_size, passing, s_local, floor, confidence) for all queries, from one search for m neighbours."""
    near = top_k(base, queries, m, passes=passes, **options)
    by = near.groupBy("query_id").agg(F.count("*").alias("sample_size"), F.count_if("passes").alias("passing"))
    confidence = F.least(F.lit(1.0), F.col("sample_size") / F.lit(float(min(m, 200)))) * F.least(F.lit(1.0), F.col("passing") / F.lit(5.0))
    return by.select(
        "query_id", "sample_size", "passing", (F.col("passing") / F.col("sample_size")).alias("s_local"), (1 / F.col("sample_size")).alias("floor"),
        confidence.alias("confidence"),
    )


def rho(local, s_global) -> Column:
    """(r - 1) / (r + 1) of the ratio r of local to global selectivity: from -1 (filter avoids the query) to 1."""
    ratio = local / F.greatest(s_global, F.lit(1e-12))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ratio - 1) / (ratio + 1)))


def local_selectivity(base: DataFrame, queries: DataFrame, m: int, passes: Column, **options) -> DataFrame:
    """One row: s_global, s_local_p10, s_local_median, rho, confidence, sample_size, passing_rows, resolution_floor."""
    counts = base.agg((F.count_if(passes) / F.count("*")).alias("s_global"))
    agg = probes(base, queries, m, passes, **options).agg(
        F.percentile("s_local", F.lit(0.1)).alias("s_local_p10"), F.percentile("s_local", F.lit(0.5)).alias("s_local_median"),
        (F.least(F.lit(1.0), F.count("*") / F.lit(16.0)) * F.percentile("confidence", F.lit(0.5))).alias("confidence"),
        F.sum("sample_size").alias("sample_size"), F.sum("passing").alias("passing_rows"), F.max("floor").alias("resolution_floor"),
    )
    return agg.crossJoin(counts).withColumn("rho", rho(F.col("s_local_p10"), F.col("s_global")))
