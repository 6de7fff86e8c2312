"""Analysis of a sweep over selectivity and correlation: regions, crossovers, proof, fronts and curves, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def winner_regions(points: DataFrame) -> DataFrame:
    """(correlation, region, strategy, low, high, n_points): runs of one winner along selectivity."""
    along = Window.partitionBy("correlation").orderBy("selectivity")
    changed = F.when(F.lag("winner").over(along).eqNullSafe(F.col("winner")) & (F.row_number().over(along) > 1), 0).otherwise(1)
    marked = points.where("winner is not null").withColumn("changed", changed).withColumn("region", F.sum("changed").over(along))
    return marked.groupBy("correlation", "region").agg(F.first("winner").alias("strategy"), F.min("selectivity").alias("low"), F.max("selectivity").alias("high"), F.count("*").alias("n_points"))


def crossovers(points: DataFrame) -> DataFrame:
    """(correlation, lower, upper, estimated, from_strategy, to_strategy) where neighbours have different winners."""
    along = Window.partitionBy("correlation").orderBy("selectivity")
    pairs = points.withColumn("upper", F.lead("selectivity").over(along)).withColumn("to_strategy", F.lead("winner").over(along))
    low, high = F.col("selectivity"), F.col("upper")
    middle = F.when((low > 0) & (high > 0), F.sqrt(low * high)).otherwise((low + high) / 2)
    return pairs.where("winner <> to_strategy").select("correlation", low.alias("lower"), "upper", middle.alias("estimated"), F.col("winner").alias("from_strategy"), "to_strategy")


def win_counts(points: DataFrame) -> DataFrame:
    """(winner, wins)."""
    return points.where("winner is not null").groupBy("winner").agg(F.count("*").alias("wins"))


def proof(points: DataFrame, *, min_bins: int = 3, min_correlations: int = 3, min_match: float = 0.8, min_failures: int = 1, min_points: int = 3) -> DataFrame:
    """(name, passed, actual, required): the checks of a sweep with predictions (predicted, predicted_ok, winner, postfilter_ok).

    A prediction is safe where postfilter fails if it is another strategy and that one was viable (predicted_ok).
    """
    match = F.avg((F.col("predicted") == F.col("winner")).cast("double"))
    failed = ~F.col("postfilter_ok")
    one = points.agg(
        F.count_distinct("selectivity").cast("double").alias("bins"), F.count_distinct("correlation").cast("double").alias("correlations"), F.count("*").cast("double").alias("points"),
        F.count("predicted").cast("double").alias("predictions"), match.alias("match"), F.count_if(failed).cast("double").alias("failures"),
        F.count_if(failed & (F.col("predicted") != "postfilter") & F.col("predicted_ok")).cast("double").alias("safe"),
    )
    rows = [
        ("minimum_points", F.col("points") >= min_points, F.col("points"), F.lit(float(min_points))),
        ("selectivity_bins", F.col("bins") >= min_bins, F.col("bins"), F.lit(float(min_bins))),
        ("correlation_bins", F.col("correlations") >= min_correlations, F.col("correlations"), F.lit(float(min_correlations))),
        ("predictions_present", F.col("predictions") == F.col("points"), F.col("predictions"), F.col("points")),
        ("prediction_match_rate", F.coalesce(F.col("match") >= min_match, F.lit(False)), F.col("match"), F.lit(float(min_match))),
        ("postfilter_failures", F.col("failures") >= min_failures, F.col("failures"), F.lit(float(min_failures))),
        ("safe_when_postfilter_fails", F.col("safe") == F.col("failures"), F.col("safe"), F.col("failures")),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), p.alias("passed"), a.alias("actual"), r.alias("required")) for n, p, a, r in rows))))


def monotone(curve: DataFrame, *by: str) -> DataFrame:
    """(*by, ef, recall): measured recall made non-decreasing in ef, by the columns named."""
    upto = Window.partitionBy(*(by or [F.lit(1)])).orderBy("ef").rowsBetween(Window.unboundedPreceding, 0)
    return curve.select(*by, "ef", F.max("recall").over(upto).alias("recall"))


def pareto(points: DataFrame, *by: str) -> DataFrame:
    """The points (strategy, recall, qps) that no other beats, by the columns named: none is as good in both and better in one.

    Equal points stay together.
    """
    # of all points at least as fast, itself must have the best recall, and of that recall be the fastest
    upto = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("qps")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.struct("recall", "qps")).over(upto)
    return points.withColumn("best", best).where(F.col("best") == F.struct("recall", "qps")).drop("best")
