"""Runs of searches with what they cost: time, and the rows and bytes that their scans read.

Each run is a job group, so everything Spark did for it, in however many jobs, is found by that group: rows and bytes read, bytes shuffled
and CPU time of all its stages. Time is of the whole run as the user waits for it. Rows and bytes are the same on every repeat; time isn't.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.plans.costs import Calibration, fit

RUNS = "strategy string, repeat int, ms double, rows_read long, bytes_read long, shuffled_bytes long, cpu_ms double"


def _group_totals(spark: SparkSession, group: str) -> tuple[int, int, int, float]:
    """Rows and bytes read, bytes shuffled and CPU milliseconds of a job group, once Spark has told all it knows."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    rows = size = moved = 0
    cpu = 0.0
    for stage in stages:
        try:
            data = store.lastStageAttempt(stage)
        except Py4JJavaError as e:  # Spark forgets stages that it skipped before others
            if "NoSuchElementException" not in str(e.java_exception):
                raise
            continue
        if data.status().toString() == "COMPLETE":  # others stood already
            rows, size, moved, cpu = rows + data.inputRecords(), size + data.inputBytes(), moved + data.shuffleWriteBytes(), cpu + data.executorCpuTime() / 1e6
    return rows, size, moved, cpu


def timed_runs(spark: SparkSession, runs: dict[str, Callable[[], DataFrame]], repeats: int = 3) -> DataFrame:
    """(strategy, repeat, ms, rows_read, bytes_read, shuffled_bytes, cpu_ms): every run built and carried out in full `repeats` times, round by round."""
    context, out = spark.sparkContext, []
    for repeat in range(repeats):
        for name, run in runs.items():
            group = f"run-{uuid.uuid4().hex}"
            context.setJobGroup(group, f"{name}, repeat {repeat}")
            try:
                began = time.perf_counter()
                run().write.format("noop").mode("overwrite").save()
                ms = 1000 * (time.perf_counter() - began)
            finally:
                context.setLocalProperty("spark.jobGroup.id", None)
                context.setLocalProperty("spark.job.description", None)
            rows, size, moved, cpu = _group_totals(spark, group)
            out.append((name, repeat, ms, rows, size, moved, cpu))
    return spark.createDataFrame(out, RUNS)


def summarised(runs: DataFrame, n_queries: int) -> DataFrame:
    """(strategy, repeats, rows_read, bytes_read, shuffled_bytes, p50_ms, p95_ms, ms_per_query): by strategy; per query by the median run."""
    q = lambda p: F.percentile("ms", F.lit(p))
    by = runs.groupBy("strategy").agg(
        F.count("*").alias("repeats"), *(F.max(c).alias(c) for c in ("rows_read", "bytes_read", "shuffled_bytes")), q(0.5).alias("p50_ms"), q(0.95).alias("p95_ms")
    )
    return by.withColumn("ms_per_query", F.col("p50_ms") / max(1, n_queries))


def calibrated(summary: DataFrame, recalls: dict[int, float], *, n_rows: int, share: float, k: int, dataset_id: str = "measured") -> Calibration:
    """A calibration from the summary of runs named exact and postfilter_<frontier>, with the recall of each frontier."""
    us = {r["strategy"]: 1000 * r["ms_per_query"] for r in summary.collect()}
    post = [(ef, us[f"postfilter_{ef}"], recall) for ef, recall in sorted(recalls.items())]
    return fit(n_rows, share, k, us["exact"], post, dataset_id)


def save_runs(runs: DataFrame, path: str) -> None:
    """A table of runs or of their summary as CSV with a header (a path that ends in .csv) or as JSON lines."""
    if path.endswith(".csv"):
        runs.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row for each run
    else:
        runs.coalesce(1).write.mode("overwrite").json(path)
