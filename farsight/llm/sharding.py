"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing.

A partial partition is a row of sums, one for each shard. Differencing combines the two partial partitions of the
largest spread again and again, the fullest shards of one with the emptiest of the other, until one is left.

Only a bounded number of parts takes part in it: a group (all documents of equal text) of at least a small share of all
bytes is a part of its own, the smaller groups are dealt by hash to bundles of about that share. Both kinds together are
at most `2 * parts` for each shard, whatever the corpus; so the plan is made in the driver, from sums alone, and two
broadcast tables of that size give each document its shard. Texts are read once and never shuffled.

Defined results: a null text has no bytes and stands in one group with the empty texts; a null doc_id is kept; rows that
repeat a doc_id are rows of their own; an empty table has no rows; further input columns are ignored, or kept by `placed`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farsight.llm.shared import documents, text_or_empty, written

SHARDS = 40
#: Bytes that each document takes besides its text.
OVERHEAD = 16
#: Parts for each shard: groups of at least 1 / (shards * PARTS) of all bytes stand alone, and so many bundles share the rest.
PARTS = 500


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each of `sizes`, by differencing. Ties go to the earlier part."""
    n = len(sizes)
    shard = np.zeros(n, np.int64)
    if n == 0 or shards == 1:
        return shard
    spreads = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(spreads)
    sums: dict[int, np.ndarray] = {}  # of combined partitions, descending
    made: list[tuple[int, int, np.ndarray]] = []

    def taken(i: int) -> np.ndarray:
        if i >= n:
            return sums.pop(i)
        row = np.zeros(shards, np.int64)
        row[0] = sizes[i]
        return row

    while len(spreads) > 1:
        (_, a), (_, b) = heapq.heappop(spreads), heapq.heappop(spreads)
        total = taken(a) + taken(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[n + len(made)] = total
        heapq.heappush(spreads, (int(total[-1] - total[0]), n + len(made)))
        made.append((a, b, order))
    # from the last partition back: where[i] is the shard that position i of a partition became
    where = {n + len(made) - 1: np.arange(shards)}
    for number in range(len(made) - 1, -1, -1):
        a, b, order = made[number]
        own = np.empty(shards, np.int64)
        own[order] = where.pop(n + number)
        for part, places in ((a, own), (b, own[::-1])):
            if part < n:
                shard[part] = places[0]
            else:
                where[part] = places
    return shard


@dataclass(frozen=True)
class Plan:
    """Which shard each large group (by its key) and each bundle of small ones goes to."""

    large: DataFrame
    bundles: DataFrame
    n_bundles: int

    def placed(self, rows: DataFrame, key: str = "group_key") -> DataFrame:
        """`rows` with `shard`, by two broadcast joins."""
        bundle = F.pmod(F.xxhash64(key), F.lit(max(1, self.n_bundles)))
        own, shared = F.broadcast(self.large.toDF("key_", "own_")), F.broadcast(self.bundles.toDF("bundle_", "shared_"))
        joined = rows.join(own, F.col(key) == F.col("key_"), "left").withColumn("of_", bundle).join(shared, F.col("of_") == F.col("bundle_"), "left")
        return joined.withColumn("shard", F.coalesce("own_", "shared_")).drop("key_", "own_", "of_", "bundle_", "shared_")


def plan(groups: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> Plan:
    """A plan for `groups` (group_key binary, bytes long), one row for each group."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, -(-total // (shards * parts)))
    large = [(bytes(r["group_key"]), r["bytes"]) for r in groups.where(F.col("bytes") >= least).collect()]  # at most shards * parts
    large.sort(key=lambda r: (-r[1], r[0]))
    n_bundles = -(-(total - sum(b for _, b in large)) // least)
    small = groups.where(F.col("bytes") < least).groupBy(F.pmod(F.xxhash64("group_key"), F.lit(max(1, n_bundles))).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    bundles = sorted(((r["bundle"], r["bytes"]) for r in small.collect()), key=lambda r: (-r[1], r[0]))
    shard = difference(np.array([b for _, b in large + bundles], np.int64), shards)
    rows = lambda held, at: [(k, int(s)) for (k, _), s in zip(held, shard[at : at + len(held)], strict=True)]
    return Plan(
        spark.createDataFrame(rows(large, 0), "group_key binary, shard int"), spark.createDataFrame(rows(bundles, len(large)), "bundle long, shard int"), n_bundles
    )


def group_key(text: str = "text"):
    """What equal texts have in common, and no others: 32 bytes of SHA-256."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def _numbered(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` with the task that reads them and their number there among those of their shard."""

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, task = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in it:
            shard = batch["shard"].to_numpy()
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            within = np.empty(len(batch), np.int64)
            within[order] = np.arange(len(batch)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(before, n)
            before += n
            yield batch.assign(task_=task, within_=within)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(counted, f"{columns}, task_ int, within_ long")


def with_slots(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`rows` with `slot`, gapless from 0 in each shard: places within a task, and before it the counts of earlier tasks."""
    table = written(_numbered(rows, shards), "placed")
    counts = table.groupBy("shard", "task_").count()
    before = Window.partitionBy("shard").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "task_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    return table.join(starts, ["shard", "task_"]).withColumn("slot", F.col("before_") + F.col("within_")).drop("task_", "within_", "before_")


def plan_documents(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> tuple[Plan, DataFrame]:
    """A plan for whole documents, and their digests (doc_id, size, text_crc32, group_key) in the shared folder."""
    text = text_or_empty()
    size = F.octet_length(text).cast("long") + OVERHEAD
    digests = written(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key().alias("group_key")), "digests")
    return plan(digests.groupBy("group_key").agg(F.sum("size").alias("bytes")), shards, parts), digests


def shard_documents(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs (doc_id, text)."""
    made, digests = plan_documents(docs, shards, parts)
    return with_slots(made.placed(digests).drop("group_key"), shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, parts: int = PARTS) -> None:
    """All columns of `docs` in folders by shard. Each task writes what it reads, so no text is shuffled."""
    made, _ = plan_documents(docs, shards, parts)
    made.placed(docs.withColumn("group_key", group_key())).drop("group_key").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, by the law `bytes`."""
    none = F.lit(None).cast("int")
    return shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), none.alias("grown_shard")
    )
