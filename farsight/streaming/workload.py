"""Statement logs that keep arriving: shapes rolled up by event-time window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.operators.workload import shapes


def rolling_shapes(log: DataFrame, *, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, fingerprint, template, calls, total_exec_time_ms) of a streaming log with an event time column `ts`."""
    marked = log.withWatermark("ts", late)
    keyed = shapes(marked.withColumn("queryid", F.struct("queryid", "ts"))).withColumn("ts", F.col("queryid.ts"))
    return keyed.groupBy(F.window("ts", window), "fingerprint", "template").agg(F.sum("calls").alias("calls"), F.sum("total_exec_time_ms").alias("total_exec_time_ms"))
