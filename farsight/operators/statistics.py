"""Column statistics computed by Spark, and filter selectivities estimated from them.

Statistics of a column: null fraction, distinct values, the most common values with their shares, and the bounds of
a histogram of equal counts over the other values. The values of each column are counted once, with partial sums before
the shuffle; all else comes from these counts, and only the few most common values and the bounds reach the driver.
"""

from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farsight.functions.filters import Predicate

LEAST = 1e-12
DEFAULT_RANGE = 1 / 3
MCV_TARGET, BOUNDS = 100, 100
#: Distinct values that one task may hold for their percentiles.
MOST_VALUES = 1 << 16


@dataclass(frozen=True)
class ColumnStats:
    """Statistics of one column. bounds: of the values that are not among the most common ones."""

    name: str
    null_frac: float
    n_distinct: float
    common: tuple = ()
    shares: tuple[float, ...] = ()
    bounds: tuple = ()
    correlation: float | None = None
    avg_width: float | None = None


@dataclass(frozen=True)
class TableStats:
    """Row count and column statistics of one table; groups: joint shares of several columns."""

    n_rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)
    groups: dict[tuple[str, ...], dict[tuple, float]] = field(default_factory=dict)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_rows, null_frac, n_distinct, avg_width): one pass over all columns."""
    aggregates = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggregates += [F.count(c).alias(f"c{i}"), F.count_distinct(c).alias(f"d{i}"), F.avg(F.length(F.col(c).cast("string"))).alias(f"w{i}")]
    wide = df.agg(*aggregates)
    part = lambda i, c: F.struct(
        F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.when(F.col("n") == 0, 0.0).otherwise(1 - F.col(f"c{i}") / F.col("n")).alias("null_frac"),
        F.col(f"d{i}").alias("n_distinct"), F.col(f"w{i}").alias("avg_width"),
    )
    return wide.select(F.inline(F.array(*(part(i, c) for i, c in enumerate(columns)))))


def most_common(df: DataFrame, columns: list[str], target: int = MCV_TARGET, *, at_least: int = 2) -> DataFrame:
    """(column_name, rank, value, n, share): the `target` most common values of each column, as text; ties by value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = df.select(F.inline(pairs)).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    ranked = counts.where(F.col("n") >= at_least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= target)
    total = df.agg(F.count("*").alias("n_rows"))
    return ranked.crossJoin(F.broadcast(total)).select("column_name", "rank", "value", "n", (F.col("n") / F.col("n_rows")).alias("share"))


def histogram_bounds(df: DataFrame, column: str, parts: int = BOUNDS) -> DataFrame:
    """(bound_no, bound): exact bounds of `parts` bins of equal counts of a numeric column."""
    cuts = F.array(*(F.lit(i / parts) for i in range(parts + 1)))
    return df.agg(F.percentile(column, cuts).alias("bounds")).select(F.posexplode("bounds").alias("bound_no", "bound"))


def ranked_bounds(df: DataFrame, column: str, parts: int = BOUNDS) -> DataFrame:
    """(bound_no, bound): the values at `parts` + 1 evenly spaced ranks of a column of any ordered type, nulls left out.

    Equal values are counted before the shuffle. The distinct values are then sorted by range, each task adds the counts
    of its own, and only one count a task is summed over: no task and no buffer holds all values. A column without
    values has no bounds.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("bound")).agg(F.count("*").alias("n"))
    # the rank of the bound i, from 0, is floor(i * (all - 1) / parts)
    numbers = F.filter(F.sequence(F.lit(0), F.lit(parts)), lambda i: _rank(i, parts).between(F.col("end") - F.col("n"), F.col("end") - 1))
    return _placed(counts).select(F.explode(numbers).alias("bound_no"), "bound")


def _placed(counts: DataFrame) -> DataFrame:
    """(bound, n, end, all) of counts (bound, n): the rows up to and with each value, and of all values."""
    parted = counts.repartitionByRange("bound").withColumn("task_", F.spark_partition_id()).persist()  # ranges are drawn once
    totals = parted.groupBy("task_").agg(F.sum("n").alias("in_task"))
    upto = Window.partitionBy(F.lit(1)).orderBy("task_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = totals.select("task_", (F.sum("in_task").over(upto) - F.col("in_task")).alias("before"), F.sum("in_task").over(Window.partitionBy(F.lit(1))).alias("all"))
    within = Window.partitionBy("task_").orderBy("bound").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parted.join(F.broadcast(before), "task_").withColumn("end", F.col("before") + F.sum("n").over(within))


def percentiles(counts: DataFrame, cuts: list[float]) -> tuple[float, ...]:
    """Exact, interpolated percentiles of counts (bound double, n), as Spark's percentile has them, but with no buffer of all values; none of no values."""
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return ()
    places = [(total - 1) * c for c in cuts]
    wanted = F.array(*(F.lit(r).cast("long") for r in sorted({f(p) for p in places for f in (math.floor, math.ceil)})))
    at = F.filter(wanted, lambda r: r.between(F.col("end") - F.col("n"), F.col("end") - 1))
    held = {r["rank"]: r["bound"] for r in _placed(counts).select(F.explode(at).alias("rank"), "bound").collect()}  # two for each cut at most
    low, high = ([held[f(p)] for p in places] for f in (math.floor, math.ceil))
    return tuple(a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for a, b, p in zip(low, high, places, strict=True))


def _rank(i, parts: int):
    return F.floor(i * (F.col("all") - 1) / F.lit(parts))


def order_correlation(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(column_name, correlation): how the numbers of each column follow the column that the table is stored by, in one aggregation."""
    one = df.agg(*(F.corr(F.col(order).cast("double"), F.col(c).cast("double")).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("correlation")) for c in columns))))


def joint_shares(df: DataFrame, columns: list[str], target: int = MCV_TARGET) -> DataFrame:
    """(columns..., n, share): the most common combinations of several columns."""
    total = df.agg(F.count("*").alias("n_rows"))
    counts = df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns).limit(target)
    return counts.crossJoin(F.broadcast(total)).select(*columns, "n", (F.col("n") / F.col("n_rows")).alias("share"))


def analyze(df: DataFrame, columns: list[str], *, target: int = MCV_TARGET, parts: int = BOUNDS, most: int = MOST_VALUES) -> TableStats:
    """A snapshot of these columns' statistics on the driver: at most `target` values and `parts` bounds each.

    Every column is read once: its values are counted, and all else comes from the counts. Columns of more than `most` values have their
    bounds by rank, so that no task holds all values.
    """
    n_rows, out = df.count() if not columns else 0, {}
    for c in columns:
        counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).persist()
        known = F.col("value").isNotNull()
        text = F.length(F.col("value").cast("string"))
        n_rows, n_values, n_distinct, width = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)), F.count("value"), F.sum(text * F.col("n")) / F.sum(F.when(known, F.col("n")))).first()
        top = counts.where(known & (F.col("n") > 1)).orderBy(F.desc("n"), "value").limit(target).collect()
        null_frac = 1 - n_values / n_rows if n_rows else 0.0
        if n_distinct > target:  # keep only what is commoner than the average
            mean = n_rows * (1 - null_frac) / n_distinct
            top = [r for r in top if r["n"] > 1.25 * mean]
        common = tuple(r["value"] for r in top)
        bounds = ()
        if len(common) < n_distinct and df.schema[c].dataType.typeName() not in ("boolean", "array", "string"):
            timed = df.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
            as_number = F.unix_micros(F.col("value").cast("timestamp")) / 1e6 if timed else F.col("value")
            rest = counts.where(known & (~F.col("value").isin(*common) if common else F.lit(True))).select(as_number.cast("double").alias("bound"), "n")
            cuts = [i / parts for i in range(parts + 1)]
            bounds = percentiles(rest, cuts) if n_distinct > most else tuple(rest.agg(F.percentile("bound", F.array(*map(F.lit, cuts)), F.col("n"))).first()[0] or ())
        counts.unpersist()
        out[c] = ColumnStats(c, null_frac, float(n_distinct), common, tuple(r["n"] / n_rows for r in top), bounds, None, width)
    return TableStats(n_rows, out)


def clamp(x: float) -> float:
    """Into [1e-12, 1]."""
    return min(1.0, max(LEAST, x))


def _number(value) -> float | None:
    """A value on the scale of histogram bounds; None if it has no place there."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=value.tzinfo or dt.timezone.utc).timestamp()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day, tzinfo=dt.timezone.utc).timestamp()
    try:
        return float(value)
    except ValueError:
        pass
    try:
        return _number(dt.datetime.fromisoformat(value.replace("Z", "+00:00")))
    except ValueError:
        return None


def equal_selectivity(s: ColumnStats, value) -> float:
    """The share of a common value, else an even share of what the common values leave."""
    known = dict(zip(map(str, s.common), s.shares, strict=True))
    if str(value) in known:
        return clamp(known[str(value)])
    rest = (1 - s.null_frac - sum(s.shares)) / max(1.0, s.n_distinct - len(s.common))
    return clamp(min(rest, min(s.shares)) if s.shares else rest)


def below_selectivity(s: ColumnStats, value) -> float:
    """The share below a value: common values below it, and its place among the bounds for the others."""
    number = _number(value)
    if number is None:
        below = [str(c) < str(value) for c in s.common] if isinstance(value, str) and s.common and all(isinstance(c, str) for c in s.common) else None
        if below is None:
            return DEFAULT_RANGE
        return clamp(sum(share for share, b in zip(s.shares, below, strict=True) if b) + (1 - s.null_frac - sum(s.shares)) * DEFAULT_RANGE)
    common = sum(share for c, share in zip(s.common, s.shares, strict=True) if (x := _number(c)) is not None and x < number)
    rest = 1 - s.null_frac - sum(s.shares)
    if len(s.bounds) < 2:
        return clamp(common + rest * (DEFAULT_RANGE if not s.common or rest > 1e-9 else 0.0))
    if number <= s.bounds[0]:
        part = 0.0
    elif number >= s.bounds[-1]:
        part = 1.0
    else:
        i = bisect_left(s.bounds, number)
        low, high = s.bounds[i - 1], s.bounds[i]
        part = (i - 1 + ((number - low) / (high - low) if high > low else 0.5)) / (len(s.bounds) - 1)
    return clamp(common + rest * part)


def selectivity(stats: TableStats, p: Predicate) -> float:
    """The estimated share of rows that meet one predicate."""
    s = stats.columns[p.column]
    if p.op == "=":
        return equal_selectivity(s, p.values[0])
    if p.op == "in":
        return clamp(sum(equal_selectivity(s, v) for v in p.values))
    if p.op == "true":
        shares = dict(zip(s.common, s.shares, strict=True))
        return clamp(shares.get(True, 0.5))
    if p.op == "<":
        return below_selectivity(s, p.values[0])
    if p.op == "<=":
        return clamp(below_selectivity(s, p.values[0]) + _exactly(s, p.values[0]))
    if p.op == ">":
        return clamp(1 - s.null_frac - below_selectivity(s, p.values[0]) - _exactly(s, p.values[0]))
    if p.op == ">=":
        return clamp(1 - s.null_frac - below_selectivity(s, p.values[0]))
    low, high = p.values
    return clamp(below_selectivity(s, high) + _exactly(s, high) - below_selectivity(s, low))


def _exactly(s: ColumnStats, value) -> float:
    """The share of a common value; 0 for others, which a histogram does not tell apart."""
    return dict(zip(map(str, s.common), s.shares, strict=True)).get(str(value), 0.0)


def conjunction_selectivity(stats: TableStats, predicates: tuple[Predicate, ...]) -> float:
    """The product of the predicates' shares, as if they were independent."""
    return clamp(reduce(lambda x, p: x * selectivity(stats, p), predicates, 1.0))


def health(snapshot_rows: int, current_rows: int, changed_rows: int | None = None) -> str:
    """fresh, stale (1,000 rows and a fifth of the table changed) or never_analyzed (no snapshot)."""
    if snapshot_rows < 0:
        return "never_analyzed"
    changed = abs(current_rows - snapshot_rows) if changed_rows is None else changed_rows
    return "stale" if changed >= 1000 and changed >= 0.2 * max(1, snapshot_rows) else "fresh"


def suggest_joint_statistics(stats: TableStats, predicates: tuple[Predicate, ...], measured: float | None = None) -> list[dict]:
    """Columns whose joint shares would help: at least two in the filter and no snapshot covers them."""
    columns = tuple(dict.fromkeys(p.column for p in predicates))
    if len(columns) < 2 or any(set(columns) <= set(g) for g in stats.groups):
        return []
    estimated = conjunction_selectivity(stats, predicates)
    diverged = measured is not None and severity(estimated, measured) != "ok"
    return [{"columns": columns, "confidence": 0.75 if diverged else 0.35, "call": f"joint_shares(df, {list(columns)!r})"}]


def severity(estimated: float, measured: float) -> str:
    """How far two selectivities are apart: critical, warning or ok."""
    ratio, delta = max(estimated, LEAST) / max(measured, LEAST), abs(estimated - measured)
    if ratio <= 0.1 or ratio >= 10 or delta >= 0.25:
        return "critical"
    return "warning" if ratio <= 0.5 or ratio >= 2 or delta >= 0.05 else "ok"
