"""The folder that driver and executors share."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Only where driver and executors are one process, as in tests.
LOCAL = "/tmp/checkpoints"


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a local one (then also set for checkpoint()) on a local master, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(LOCAL)
    return LOCAL
