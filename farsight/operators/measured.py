"""Filters times frontiers, measured: recall, returned rows and rows examined of the strategies over a whole table.

All frontiers of all filters come from one search: the deepest frontier of each query carries the flags of every filter,
and its smaller frontiers are its first ranks. A frontier holds the true nearest rows, so what passes within it is what the truth begins
with: recall follows from counts, and the truth of a filter needs no search of its own.
Cost is rows examined for one query, which is the same on every machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.operators import search


def frontiers(base: DataFrame, queries: DataFrame, filters: dict[str, Column], deepest: int, **options) -> DataFrame:
    """(query_id, place, vec_id, filter) of the rows among the `deepest` nearest of each query that pass each filter."""
    passing = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in filters.items())), lambda x: x.isNotNull())
    near = search.top_k(base, queries, deepest, **options).select("query_id", F.col("rank").alias("place"), "vec_id")
    flags = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.explode(passing).alias("filter"))
    return near.join(flags, "vec_id").select("query_id", "place", "vec_id", "filter")


def sweep(base: DataFrame, queries: DataFrame, filters: dict[str, Column], efs: list[int], k: int, **options) -> DataFrame:
    """(filter, ef, selectivity, recall, returns_k, mean_results, s_local): the postfilter strategy at each frontier.

    s_local is the share of the frontier that passes. Queries without a true row count as recall 1; a row for which a
    filter is null does not pass it; an empty table or no queries give no rows.
    """
    near = frontiers(base, queries, filters, max(efs), **options)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("filter", "query_id").orderBy("place")))
    within = [(f"passing_{e}", F.col("place") <= e) for e in efs] + [(f"found_{e}", (F.col("place") <= e) & (F.col("rank") <= k)) for e in efs]
    by_query = first.groupBy("filter", "query_id").agg(*(F.count_if(c).alias(n) for n, c in within))
    named = lambda of: F.inline(F.array(*(F.struct(F.lit(n).alias("filter"), *(F.col(f"{c}_{i}").alias(c) for c in of)) for i, n in enumerate(filters))))
    has = F.col(options.get("vec_col", "embedding")).isNotNull()
    shares = [(F.avg(c.cast("double")).alias(f"selectivity_{i}"), F.least(F.count_if(c & has), F.lit(k)).alias(f"n_truth_{i}")) for i, c in enumerate(F.coalesce(c, F.lit(False)) for c in filters.values())]
    grid = base.agg(*(c for pair in shares for c in pair)).select(named(("selectivity", "n_truth")))
    cells = queries.select("query_id", F.explode(F.array(*map(F.lit, filters))).alias("filter"))
    counted = cells.join(F.broadcast(grid), "filter").join(by_query, ["filter", "query_id"], "left").fillna(0, [n for n, _ in within])
    one = lambda e: F.struct(F.lit(e).alias("ef"), F.col(f"passing_{e}").alias("passing"), F.col(f"found_{e}").alias("n_found"))
    every = counted.select("filter", "query_id", "selectivity", "n_truth", F.inline(F.array(*map(one, efs))))
    recall = F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_truth"))
    return every.groupBy("filter", "ef", "selectivity").agg(
        F.avg(recall).alias("recall"), F.min(F.col("n_found") >= F.col("n_truth")).alias("returns_k"), F.avg("n_found").alias("mean_results"), F.avg(F.col("passing") / F.col("ef")).alias("s_local")
    )


def best(measured: DataFrame, n_rows: Column, target: float) -> DataFrame:
    """(filter, selectivity, winner, ef, cost): the fewest rows examined at the target recall with all k rows; exact where no frontier does.

    Exact examines every row that passes.
    """
    exact = F.col("selectivity") * n_rows
    viable = F.col("returns_k") & (F.col("recall") >= target)
    least = measured.groupBy("filter", "selectivity").agg(F.min(F.when(viable, F.col("ef"))).alias("ef"))
    post = F.col("ef").isNotNull() & (F.col("ef") < exact)
    return least.select("filter", "selectivity", F.when(post, "postfilter").otherwise("exact").alias("winner"), F.when(post, F.col("ef")).alias("ef"), F.when(post, F.col("ef").cast("double")).otherwise(exact).alias("cost"))


def predictions(measured: DataFrame, k: int) -> DataFrame:
    """(filter, ef, predicted, measured, severity): the recall that the filter's overall share lets one expect, beside the measured one."""
    expected = F.least(F.lit(1.0), F.col("selectivity") * F.col("ef") / F.lit(k))
    held = [F.greatest(x, F.lit(1e-12)) for x in (F.col("predicted"), F.col("measured"))]
    ratio, apart = held[0] / held[1], F.abs(F.col("predicted") - F.col("measured"))
    critical, warning = ((ratio <= low) | (ratio >= high) | (apart >= most) for low, high, most in ((0.1, 10, 0.25), (0.5, 2, 0.05)))
    both = measured.select("filter", "ef", F.round(expected, 9).alias("predicted"), F.round("recall", 9).alias("measured"))
    return both.withColumn("severity", F.when(critical, "critical").when(warning, "warning").otherwise("ok"))
