"""What Spark's own plan of a search shows: pushed filters, pruned partitions and the strategy it amounts to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scans(df: DataFrame) -> list[dict]:
    """For each file scan: its location, columns read, pushed filters and partition filters."""
    out = []
    for part in re.split(r"\n\n(?=\(\d+\) )", plan_text(df)):
        if re.match(r"\(\d+\) Scan ", part):
            of = lambda key, p=part: (re.search(rf"^{key}: (.*)$", p, re.M) or [None, ""])[1]
            out.append({"location": of("Location"), "schema": of("ReadSchema"), "pushed": of("PushedFilters"), "pruned": of("PartitionFilters")})
    return out


def strategy_of(df: DataFrame, filtered_copies: tuple[str, ...] = ()) -> str:
    """partial, partition, postfilter (a filter above a limit) or exact, by the plan of a search."""
    found = scans(df)
    if any(path in s["location"] for s in found for path in filtered_copies):
        return "partial"
    if any(s["pruned"] not in ("", "[]") for s in found):
        return "partition"
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    lines = [re.sub(r"^[\s:+-]*", "", x) for x in tree.splitlines()]
    kinds = [x.split(" ")[0] for x in lines]
    limits = [i for i, x in enumerate(kinds) if x == "GlobalLimit"]
    if limits and any(x == "Filter" and i < limits[-1] for i, x in enumerate(kinds)):
        return "postfilter"
    return "exact"


def estimated_rows(df: DataFrame) -> float | None:
    """Catalyst's own row estimate, where it has column statistics."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return float(stats.rowCount().get().toString()) if stats.rowCount().isDefined() else None
