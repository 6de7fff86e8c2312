"""SimHash fingerprints, with DataFrame operations only.

The terms of a text are its pairs of neighbouring words (blank-separated; the last word stands alone), weighted
by their length up to 64 characters. Each bit of a term's 64-bit hash votes for or against that bit of the
fingerprint with the term's weight. Two bits are counted in one long, so a text may have 2**26 terms.

Fingerprints within a chosen Hamming radius are found by permuted block tables: of the six blocks that the 64
bits are cut into, at least three agree if at most three bits differ, so each choice of three blocks keys a table.

Defined results: a null text is the empty text, whose fingerprint is 0; equal texts have equal fingerprints; a
null doc_id comes after all others in the descending order; rows that repeat a doc_id follow each other by a hash
of their text; a table of one row is its own next document; further input columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farsight.llm.shared import documents, shuffle_partitions, text_or_empty, written

TERMS = r"(?<!\S)(?=(\S+(?:\s+\S+)?))"
MOST_WEIGHT = 64
BLOCKS, RADIUS = 6, 3
#: Ranges of doc_id at most (there are four for each shuffle partition).
MOST_RANGES = 4096


def votes(terms: DataFrame, *by: str) -> DataFrame:
    """(by..., fingerprint) from rows (by..., term): a row without terms (null) adds nothing."""
    h = terms.select(*by, F.xxhash64("term").alias("h"), F.when(F.col("term").isNull(), 0).otherwise(F.least(F.length("term"), F.lit(MOST_WEIGHT))).cast("long").alias("w"))
    pair = lambda i: F.expr(f"((h >> {i}) & 1L) + (((h >> {i + 32}) & 1L) << 32)")
    sums = h.groupBy(*by).agg(F.sum("w").alias("all"), *(F.sum(pair(i) * F.col("w")).alias(f"s{i}") for i in range(32)))
    low = [F.when(2 * F.expr(f"s{i} & 4294967295L") > F.col("all"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    high = [F.when(2 * F.expr(f"shiftrightunsigned(s{i}, 32)") > F.col("all"), F.shiftleft(F.lit(1).cast("long"), i + 32)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    return sums.select(*by, _all_of(low + high).alias("fingerprint"))


def _all_of(parts):
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return parts[0]


def terms_of(text):
    """The terms of a text column as an array."""
    return F.regexp_extract_all(text, F.lit(TERMS), 1)


def fingerprint(docs: DataFrame, *by: str) -> DataFrame:
    """(by..., fingerprint) of the texts of docs (by..., text); `by` names a row."""
    return votes(docs.select(*by, F.explode_outer(terms_of(F.col("text"))).alias("term")), *by)


def likeness(a: str, b: str):
    """The share of equal bits of two fingerprints."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def near_pairs(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (a < b) in a column `fingerprint` that differ in at most `radius` bits.

    Each pair comes out of one table only: that of the first choice of blocks that it agrees on.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))

    def key(column: str, chosen: tuple[int, ...]):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in chosen)
        return F.col(column).bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))

    distinct = fingerprints.select("fingerprint").where("fingerprint is not null").distinct()
    keys = F.array(*(F.struct(F.lit(t).alias("table"), key("fingerprint", c).alias("key")) for t, c in enumerate(tables)))
    rows = distinct.select("fingerprint", F.inline(keys))
    a, b = (rows.select("table", "key", F.col("fingerprint").alias(x)) for x in "ab")
    equal = [key("a", c) == key("b", c) for c in tables]
    first = F.coalesce(*(F.when(e, F.lit(t)) for t, e in enumerate(equal)))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (first == F.col("table_"))
    on = (F.col("table") == F.col("table_")) & (F.col("key") == F.col("key_")) & near
    return a.withColumnsRenamed({"table": "table_", "key": "key_"}).join(b, on).select("a", "b")


def _below(column: str, cuts: list[int]):
    """How many of `cuts`, in order, are below a column: counted among the last cuts of groups, then in one group."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    count = lambda among: F.size(F.filter(among, lambda x: x < F.col(column)))
    whole = count(F.array(*(F.lit(g[-1]).cast("long") for g in groups)))
    inner = F.get(F.array(*(F.array(*(F.lit(c).cast("long") for c in g)) for g in groups)), whole)
    return F.coalesce(whole * size + count(inner), F.lit(len(cuts)))


def _ranged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `tie`, a hash of the text, and `range`, which ascends as doc_id descends (null: last), then as tie ascends.

    Ranges lie between approximate quantiles of doc_id, so they hold about as many rows each, however the ids lie. An id
    that spans several quantiles, and null, are cut further by their ties.
    """
    ranges = min(MOST_RANGES, 4 * shuffle_partitions(docs.sparkSession))
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] or []  # a sketch of bounded size
    often = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    cuts = sorted(set(cuts))
    by_tie = (F.shiftright("tie", 56) + 128).cast("long")
    # an id of several quantiles is the largest of its range, so its own ranges come first
    known = (len(cuts) - _below("doc_id", cuts)).cast("long") * 512 + (F.when(F.col("doc_id").isin(*often), by_tie).otherwise(256) if often else F.lit(256))
    tied = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    return tied.withColumn("range", F.when(F.col("doc_id").isNull(), (len(cuts) + 1) * 512 + by_tie).otherwise(known))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, place, next_place, text, next_text): each row of docs (doc_id, text) with the next by descending doc_id, cyclic.

    Each range also gets the first row of the next one, so no window spans all rows.
    """
    ranged = _ranged(docs)
    first = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("first")
    heads = ranged.groupBy("range").agg(first)  # a row for each range
    before = Window.orderBy("range")
    last = Window.orderBy(F.desc("range"))
    hosts = heads.select("range", F.col("first.doc_id").alias("head"), F.bitwise_not("first.tie").alias("head_tie"), F.coalesce(F.lag("range").over(before), F.first("range").over(last)).alias("host"))
    visiting = ranged.join(F.broadcast(hosts.withColumnRenamed("range", "home")), (F.col("range") == F.col("home")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))
    visiting = visiting.select("doc_id", "text", "tie", "home", F.col("host").alias("range"), F.lit(1).alias("guest")).dropDuplicates(["home"])
    rows = ranged.select("doc_id", "text", "tie", F.col("range").alias("home"), "range", F.lit(0).alias("guest")).unionAll(visiting)
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    nxt = F.lead(F.struct("text", "home", "guest")).over(order)
    seen = rows.withColumn("at", F.row_number().over(order)).withColumn("next", nxt).where("guest = 0")
    follows = F.when(F.col("next.guest") == 1, F.lit(1)).otherwise(F.col("at") + 1)
    return seen.select(
        "doc_id", F.struct("range", "at").alias("place"), F.struct(F.col("next.home").alias("range"), follows.alias("at")).alias("next_place"),
        "text", F.col("next.text").alias("next_text"),
    )


def edited(text: str, other: str):
    """`text` with its last half replaced by as many first characters of `other` (or all of them)."""
    return F.concat(F.expr(f"left({text}, length({text}) - cast(length({text}) div 2 as int))"), F.expr(f"left({other}, cast(length({text}) div 2 as int))"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, and n_near: how many other fingerprints differ in at most RADIUS bits."""
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    pairs = with_next(docs).withColumn("edited", edited("text", "next_text"))
    row = ["doc_id", "place", "next_place", "n_chars", "edited_sha256"]
    both = pairs.select(
        "doc_id", "place", "next_place", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))),
    )
    found = fingerprint(both, *row, "kind")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("fingerprint")))
    marked = written(found.groupBy(*row).agg(one(0).alias("own"), one(1).alias("other")), "fingerprints")
    nexts = marked.select(F.col("place").alias("next_place"), F.col("own").alias("next_own"))
    near = near_pairs(marked.select(F.col("own").alias("fingerprint")))
    near = near.unionAll(near.select("b", "a")).groupBy(F.col("a").alias("own")).agg(F.count("*").alias("n_near"))
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return marked.join(nexts, "next_place").join(near, "own", "left").select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
