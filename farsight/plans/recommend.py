"""Recommend a strategy for a filtered search from statistics, local selectivity and the layouts there are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.functions.filters import Predicate, filter_columns
from farsight.operators.statistics import TableStats, conjunction_selectivity
from farsight.plans.costs import Calibration, best, estimates, frontier_for

SMALL_SHARE, MOST_VALUES = 0.10, 1024


@dataclass(frozen=True)
class Layout:
    """A registered copy of a table: filtered by predicates ("filtered") or partitioned by a column ("partitioned")."""

    path: str
    kind: str
    predicates: tuple[Predicate, ...] = ()
    column: str | None = None


def confidence_of(stats: TableStats, predicates: tuple[Predicate, ...]) -> float:
    """From the share of filter columns with statistics."""
    known = sum(p.column in stats.columns for p in predicates)
    return max(0.25, 0.65 * known / max(1, len(predicates)))


def suggests_copy(stats: TableStats, predicates: tuple[Predicate, ...], s_global: float) -> bool:
    """Whether a filtered copy is worth building: a rare filter of equalities over columns of few values."""
    return s_global <= SMALL_SHARE and bool(predicates) and all(
        p.op in ("=", "in", "true") and p.column in stats.columns and stats.columns[p.column].n_distinct <= MOST_VALUES for p in predicates
    )


def recommend(
    spark: SparkSession, stats: TableStats, predicates: tuple[Predicate, ...], *, k: int, s_local: float | None = None, local_confidence: float = 0.35,
    layouts: tuple[Layout, ...] = (), cal: Calibration | None = None, target: float = 0.95, ef: int = 40, max_scan: int = 20000,
) -> DataFrame:
    """Ranked rows (place, strategy, latency_us, recall, returns_k, viable, confidence, note), the recommended one first."""
    if ef < 1 or not 0 < target <= 1 or k < 1:
        raise ValueError("ef and k must be positive and the target in (0, 1]")
    cal = cal or Calibration()
    s_global = conjunction_selectivity(stats, predicates)
    local = s_global if s_local is None else s_local
    copy = next((x for x in layouts if x.kind == "filtered" and set(x.predicates) == set(predicates)), None)
    parted = next((x for x in layouts if x.kind == "partitioned" and x.column in filter_columns(predicates)), None)
    suggested = copy is None and suggests_copy(stats, predicates, s_global)
    rows = [(stats.n_rows, s_global, local, s_global if copy or suggested else None, s_global if parted else None, k, ef_used, max_scan, of) for ef_used, of in (
        (frontier_for(cal, target, ef, k, local), "postfilter"), (frontier_for(cal, target, ef, k), ""))]
    cases = spark.createDataFrame(rows, "n_rows long, s_global double, s_local double, s_index double, s_partition double, k int, ef int, max_scan int, of string")
    all_ = estimates(cases, cal).where((F.col("of") == "postfilter") == (F.col("strategy") == "postfilter"))
    winner = best(all_.withColumn("one", F.lit(1)), ["one"], target).select("winner")
    confidence = F.when(F.col("strategy") == "exact", confidence_of(stats, predicates)).when(F.col("strategy").isin("partial", "partition"), 0.45 if suggested else 0.5).otherwise(local_confidence)
    note = F.when((F.col("strategy") == "partial") & F.lit(suggested), "needs a filtered copy").otherwise(F.concat(F.lit("frontier "), F.col("ef")))
    viable = F.col("returns_k") & (F.col("recall") >= target)
    ranked = all_.crossJoin(F.broadcast(winner)).select("strategy", "latency_us", "recall", "returns_k", viable.alias("viable"), confidence.alias("confidence"), note.alias("note"), "priority", (F.col("strategy") == F.col("winner")).alias("won"))
    order = [F.desc("won"), F.desc("viable"), "latency_us", "priority"]
    from pyspark.sql import Window

    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).select("place", "strategy", "latency_us", "recall", "returns_k", "viable", "confidence", "note").orderBy("place")


#: Confidence from which on it counts as high, and as medium; and how far local and global selectivity may differ without remark.
HIGH, MEDIUM, APART = 0.75, 0.45, 0.25


def decision(ranked: DataFrame) -> DataFrame:
    """One row for a ranked recommendation: winner, runner_up, whether each is viable, n_candidates, n_viable, ratio, confidence, confidence_level.

    ratio is the runner-up's latency in those of the winner. Without rows, winner and runner-up are null.
    """
    at = lambda place, column: F.max(F.when(F.col("place") == place, F.col(column)))
    one = ranked.agg(
        at(1, "strategy").alias("winner"), at(1, "viable").alias("winner_viable"), at(2, "strategy").alias("runner_up"), at(2, "viable").alias("runner_up_viable"), F.count("*").alias("n_candidates"),
        F.count_if("viable").alias("n_viable"), (at(2, "latency_us") / F.nullif(at(1, "latency_us"), F.lit(0.0))).alias("ratio"), at(1, "confidence").alias("confidence"), at(1, "note").alias("note"),
    )
    level = F.when(F.col("confidence") >= HIGH, "high").when(F.col("confidence") >= MEDIUM, "medium").when(F.col("confidence").isNotNull(), "low")
    return one.withColumn("confidence_level", level)


def reasons(ranked: DataFrame, *, rho: float | None = None, observed: str | None = None) -> DataFrame:
    """(reason_no, reason): why the winner of a ranked recommendation was taken, and what to beware of, as short codes with their figures.

    rho compares local with global selectivity, None where it was not measured; `observed` is the strategy that Spark's plan of the search amounts to.
    """
    c = F.col
    say = lambda code, *parts: F.concat_ws(" ", F.lit(code), *parts)
    every = [
        F.when(c("winner_viable"), say("cheapest_viable", c("winner"))).otherwise(say("fallback_none_viable", c("winner"))),
        F.when(F.lit(rho is None), say("local_selectivity_not_measured")),
        F.when(c("runner_up").isNull(), say("no_runner_up")).when(~c("runner_up_viable"), say("runner_up_not_viable", c("runner_up"))).when(c("ratio").isNotNull(), say("runner_up_costs_more", c("runner_up"), F.format_number("ratio", 3))),
        F.when(c("winner").isin("partial", "partition"), F.when(c("note").startswith("needs"), say("copy_to_be_built", c("winner"))).otherwise(say("copy_at_hand", c("winner")))),
        F.when(F.lit(observed).isNotNull() & (F.lit(observed) != c("winner")), say("plan_differs", F.lit(observed))),
        F.when(F.lit(rho is not None and rho <= -APART), say("filter_avoids_queries")).when(F.lit(rho is not None and rho >= APART), say("filter_gathers_near_queries")),
        F.when(c("confidence") < MEDIUM, say("low_confidence")),
    ]
    return decision(ranked).where("winner is not null").select(F.posexplode(F.filter(F.array(*every), lambda x: x.isNotNull())).alias("reason_no", "reason"))
