"""Distributed union-find: connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.llm.shared import removed, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large) or smaller neighbours of each node to the smallest node it knows. links: (a, b) with a > b."""
    if large:
        links = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    # no aggregate follows the join in its stage, so that AQE may split the links of a node with very many
    near = links.join(least.select(F.col("a").alias("a_"), F.least("a", "m").alias("m")), F.col("a") == F.col("a_"))
    if large:
        made = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(near.select("a", F.col("m").alias("b")))
    return made.where("a <> b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour only, which has none itself. links: (a, b) with a > b, distinct."""
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf")))))
    by = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.count("*").alias("n"))
    return by.where("leaves > 1 or (leaves = 1 and n > 1)").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node with a link; a component is named by its smallest node.

    links: two columns of one orderable type. Links of a node to itself and repeated links change nothing.
    Each round is written to the shared folder, so no round is ever computed again; the round before then goes.
    """
    a, b = links.columns
    kind = links.schema[a].dataType
    now = links.select(F.greatest(a, b).cast(kind).alias("a"), F.least(a, b).cast(kind).alias("b")).where("a <> b").distinct()
    now = written(now, name)
    while not _are_stars(now):
        before, now = now, written(_stars(_stars(now, True), False), name)
        removed(before)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionAll(roots)
