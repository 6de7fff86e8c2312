"""A measured grid of selectivity and correlation: what each strategy examines and finds in every cell, from one search.

Each cell is a filter of its own, drawn by a hash of the row's id: a row passes with the cell's selectivity, raised by its
correlation where the row is near some query and lowered elsewhere. The deepest frontier of all queries comes from one search; rows carry the
cells that they pass, so no cell needs a scan or a job of its own. Costs are rows examined by a query, the same on every machine:
exact examines all rows that pass, postfilter its frontier, iterative up to its k-th passing row or `max_scan`.

As the frontier holds the true nearest rows, what passes within it is what the truth begins with: recall follows from counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.operators import search

_CELL = ["selectivity", "correlation"]
STRATEGIES = ("exact", "postfilter", "iterative")
#: A row's draw in [0, 1): its id by a linear congruence modulo a prime. Fixed values.
PRIME, STEP, START = 1_000_003, 7919, 12_345


@dataclass(frozen=True)
class Grid:
    """Cells, and how deep the strategies go; a row is near a query if it is among its `hot` nearest."""

    selectivities: tuple[float, ...] = (0.02, 0.05, 0.1, 0.2, 0.4)
    correlations: tuple[float, ...] = (-0.8, 0.0, 0.8)
    efs: tuple[int, ...] = (10, 20, 40, 80, 160)
    default_ef: int = 40
    max_scan: int = 160
    probe: int = 50
    hot: int = 10
    k: int = 10
    target: float = 0.9

    def cells(self) -> Column:
        """All cells as an array of (selectivity, correlation)."""
        return F.array(*(F.struct(F.lit(s).alias("selectivity"), F.lit(c).alias("correlation")) for s in self.selectivities for c in self.correlations))


def draw(vec_id: str = "vec_id") -> Column:
    return (F.pmod(F.pmod(F.col(vec_id), F.lit(PRIME)) * STEP + START, F.lit(PRIME))) / F.lit(float(PRIME))


def measured_grid(base: DataFrame, queries: DataFrame, grid: Grid = Grid(), *, keep: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> DataFrame:  # noqa: B008
    """(selectivity, correlation, query_id, n_pass, probed, depth, found_<ef>..., found, examined) for every cell and query.

    n_pass: rows of the cell's filter; probed: how many of the first `probe` rows pass; found_<ef>: rows returned from that frontier; found
    and examined: what the iterative strategy returns and examines. A table without rows or queries gives no rows. `keep` may write a frame and
    read it back: the frontier, which several parts start from.
    """
    deepest = max(*grid.efs, grid.max_scan, grid.probe, grid.hot)
    near = keep(search.top_k(base, queries, deepest, **options).select("query_id", F.col("rank").alias("place"), "vec_id"))
    hot = near.where(F.col("place") <= grid.hot).select(F.col("vec_id").alias("hot_id")).distinct()
    rows = base.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").join(hot, F.col("vec_id") == F.col("hot_id"), "left")
    chance = lambda c: c["selectivity"] * (1 + F.when(F.col("hot_id").isNotNull(), c["correlation"]).otherwise(-c["correlation"]))
    flagged = rows.withColumn("draw", draw()).select("vec_id", F.filter(grid.cells(), lambda c: F.col("draw") < chance(c)).alias("cells"))
    sizes = flagged.select(F.inline("cells")).groupBy(*_CELL).agg(F.count("*").alias("n_pass"))
    passing = near.join(flagged, "vec_id").select("query_id", "place", F.inline("cells"))
    order = Window.partitionBy(*_CELL, "query_id").orderBy("place")
    first = passing.withColumn("r", F.row_number().over(order))
    kept = F.col("r") <= grid.k
    counted = first.groupBy(*_CELL, "query_id").agg(
        F.count_if(F.col("place") <= grid.probe).alias("probed"), F.count_if(kept & (F.col("place") <= grid.max_scan)).alias("found"),
        *(F.count_if(kept & (F.col("place") <= e)).alias(f"found_{e}") for e in grid.efs), F.max(F.when(kept & (F.col("place") <= grid.max_scan), F.col("place"))).alias("last"),
    )
    counts = ["probed", "found", *(f"found_{e}" for e in grid.efs)]
    every = queries.select("query_id", F.inline(grid.cells())).join(F.broadcast(sizes), _CELL, "left").join(counted, [*_CELL, "query_id"], "left").fillna(0, ["n_pass", *counts])
    depth = near.groupBy("query_id").agg(F.count_if(F.col("place") <= grid.probe).alias("depth"))
    want = F.least(F.col("n_pass"), F.lit(grid.k))
    examined = F.when((want > 0) & (F.col("found") >= want), F.col("last")).otherwise(grid.max_scan)
    return every.join(depth, "query_id").select(*_CELL, "query_id", "n_pass", "depth", *counts, examined.cast("double").alias("examined"))


def runs(measured: DataFrame, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """(selectivity, correlation, strategy, ef, recall, returns_k, cost): a row for each run of a strategy in a cell; cost is the p95 of rows examined."""
    want = F.least(F.col("n_pass"), F.lit(grid.k))
    recall = lambda found: F.avg(F.when(want == 0, 1.0).otherwise(F.col(found) / want))
    full = lambda found: F.min(F.col(found) >= want)
    one = lambda name, ef, r, ok, cost: F.struct(F.lit(name).alias("strategy"), F.lit(ef).cast("int").alias("ef"), r.alias("recall"), ok.alias("returns_k"), cost.cast("double").alias("cost"))
    by = measured.groupBy(*_CELL).agg(
        F.max("n_pass").alias("n_pass"), F.percentile("examined", F.lit(0.95)).alias("examined"), recall("found").alias("recall"), full("found").alias("full"),
        *(recall(f"found_{e}").alias(f"recall_{e}") for e in grid.efs), *(full(f"found_{e}").alias(f"full_{e}") for e in grid.efs),
    )
    post = [one("postfilter", e, F.col(f"recall_{e}"), F.col(f"full_{e}"), F.lit(e)) for e in grid.efs]
    return by.select(*_CELL, F.inline(F.array(one("exact", None, F.lit(1.0), F.lit(True), F.col("n_pass")), *post, one("iterative", None, F.col("recall"), F.col("full"), F.col("examined")))))


def _priority(strategy: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STRATEGIES)), strategy)


def points(measured: DataFrame, n_rows: int, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """One row for each cell: winner as measured, predicted, whether that and the default postfilter are viable, and speed-up over the latter.

    The winner examines the fewest rows of those that return all rows at the target recall; of equals the earlier of STRATEGIES. The prediction knows
    the share of the filter and the mean share among the first `probe` rows, and takes a frontier that leaves half as much again as k.
    """
    every = runs(measured, grid).withColumn("viable", F.col("returns_k") & (F.col("recall") >= grid.target))
    least = F.min(F.when(F.col("viable"), F.struct(F.round("cost", 9).alias("cost"), _priority(F.col("strategy")).alias("priority"), F.col("strategy"))))
    default = (F.col("strategy") == "postfilter") & (F.col("ef") == grid.default_ef)
    won = every.groupBy(*_CELL).agg(
        F.coalesce(least["strategy"], F.lit("exact")).alias("winner"), F.collect_list(F.struct("strategy", "ef", "viable", "cost")).alias("runs"),
        F.max(F.when(default, F.col("viable"))).alias("postfilter_ok"), F.max(F.when(default, F.col("cost"))).alias("postfilter_cost"),
    )
    share = measured.groupBy(*_CELL).agg((F.max("n_pass") / F.lit(max(1, n_rows))).alias("share"), F.avg(F.col("probed") / F.col("depth")).alias("local"))
    ef = F.element_at(F.concat(F.filter(F.array(*map(F.lit, grid.efs)), lambda e: F.col("local") * e >= 1.5 * grid.k), F.array(F.lit(None).cast("int"))), 1)
    walk = grid.k / F.greatest(F.col("local"), F.lit(1e-12))
    option = lambda name, cost: F.when(cost.isNotNull(), F.struct(F.round(cost.cast("double"), 9).alias("cost"), _priority(F.lit(name)).alias("priority"), F.lit(name).alias("strategy")))
    options = F.array(option("exact", F.col("share") * n_rows), option("postfilter", F.col("ef")), option("iterative", F.when(F.col("walk") * 1.5 <= grid.max_scan, F.col("walk"))))
    guess = share.withColumn("ef", ef).withColumn("walk", walk).withColumn("guess", F.array_min(F.filter(options, lambda o: o.isNotNull())))
    joined = won.join(guess.select(*_CELL, "share", "local", F.col("guess.strategy").alias("predicted"), F.when(F.col("guess.strategy") == "postfilter", F.col("ef")).alias("predicted_ef")), _CELL)
    used = F.element_at(F.filter("runs", lambda r: (r["strategy"] == F.col("predicted")) & r["ef"].eqNullSafe(F.col("predicted_ef"))), 1)
    out = joined.withColumn("used", used)
    return out.select(*_CELL, "share", "local", "winner", "predicted", "predicted_ef", F.col("used.viable").alias("predicted_ok"), "postfilter_ok", (F.col("postfilter_cost") / F.when(F.col("used.cost") > 0, F.col("used.cost"))).alias("speedup"))


def report(found: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: passed (all checks), n_points, match_rate, failures, safe, mean_speedup."""
    failed = ~F.col("postfilter_ok")
    one = found.agg(
        F.count("*").alias("n_points"), F.avg((F.col("predicted") == F.col("winner")).cast("double")).alias("match_rate"), F.count_if(failed).alias("failures"),
        F.count_if(failed & (F.col("predicted") != "postfilter") & F.col("predicted_ok")).alias("safe"), F.avg("speedup").alias("mean_speedup"),
    )
    return checks.agg(F.every("passed").alias("passed")).crossJoin(F.broadcast(one))  # one row each
