"""Fuzzy line dedup by MinHash, with DataFrame operations only.

A line counts in lower case without outer blanks. Its character shingles are the runs of eight characters at every
position; a shorter line is one run. Equal lines, by a 64-bit hash, are one node. Signatures of 36 minima make nine
bands of four; buckets give candidate links (see linking), each verified on the exact Jaccard likeness of the shingle
sets. The four minima of a band are of four hashes of a shingle, and the bands read these in orders that begin in
different parts of their range. Of each component of the links one line stays: the one at the smallest place
(doc_id, line number).

Defined results: a null text is kept as it is and has no lines; blank lines and lines shorter than `min_chars`
characters (trimmed) always stay; a null doc_id comes before all others; rows that repeat a doc_id share its
places: a line stays in each of them, if it stays at its place at all; a text may become empty, but no row goes.
Further columns of the input are carried along, whatever their names.
"""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.llm import linking
from farsight.llm.shared import documents, removed, scratch, written

MIN_CHARS = 8
SHINGLE = 8
BANDS, ROWS = 9, 4
SIMILARITY = 0.8
#: Minima of which the signature keeps four bits each, in longs of 16.
MARKED, PER_LONG = 32, 16
_LOWEST = -(1 << 63)
#: Upper four bits of the first hash of a shingle at which the bands begin; they go on by these steps with the other hashes.
_BEGIN, _STEP = (0, 8, 4, 12, 2, 10, 6, 14, 1), (1, 2, 4, 5)
#: A row of hashes, or a segment, is of so many shingles.
_AT_ONCE = 8
#: Bytes of a character in UTF-32, where a shingle is found without a walk through the line.
_WIDE = 4


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, at, line, node) of the lines that take part; docs: (key, text)."""
    lines = docs.select("key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.lower(F.trim("line"))).where(F.length("line") >= min_chars)
    return lines.withColumn("node", F.xxhash64("line"))


def _segments(line, at_once: int = _AT_ONCE):
    """The pieces of a line, each of the characters of `at_once` shingles (the last: of those left). No character is sought from the line's start."""
    pattern = rf"(?s)(?=(.{{{SHINGLE},{SHINGLE + at_once - 1}}})).{{1,{at_once}}}"
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(pattern), 1))


def _shingle(segment, i: int):
    """The i-th shingle of a segment, or its last one where there are fewer."""
    last = F.greatest(F.length(segment) - (SHINGLE - 1), F.lit(1))
    return F.substring(segment, F.least(F.lit(i + 1), last), F.lit(SHINGLE))


def _shingle_set(line, at_once: int = 16):
    """Hashes of the distinct shingles of a line."""
    one = lambda s: F.array(*(F.xxhash64(_shingle(s, i)) for i in range(at_once)))
    return F.array_distinct(F.flatten(F.transform(_segments(line, at_once), one)))


def _order(b: int, r: int):
    """What the r-th hashes of shingles are xor-ed with for band b: the hash least far from it, bit by bit, comes first."""
    drawn = random.Random(b * ROWS + r).getrandbits(28) | _BEGIN[b * _STEP[r] % BANDS] << 28
    return F.lit(drawn - (1 << 31)).cast("int")


def _hashed(lines: DataFrame) -> DataFrame:
    """(node, at, h0_0, h0_1, ..., h1_0, ...): ROWS hashes of each shingle of lines (node, line), `at` and at the places after it."""
    wide = lines.select("node", F.encode("line", "UTF-32").alias("wide"))
    wide = wide.select("node", "wide", F.greatest(F.floor(F.length("wide") / _WIDE).cast("int") - SHINGLE, F.lit(0)).alias("last"))
    cut = wide.select("node", "wide", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(_AT_ONCE))).alias("at"))
    shingle = lambda j: F.substring("wide", F.least(F.col("at") + j, F.col("last")) * _WIDE + 1, F.lit(SHINGLE * _WIDE))
    first = cut.select("node", "at", *(F.hash(shingle(j)).alias(f"h{j}_0") for j in range(_AT_ONCE)))
    return first.select("*", *(F.hash(f"h{j}_0", F.lit(r)).alias(f"h{j}_{r}") for j in range(_AT_ONCE) for r in range(1, ROWS)))


def _signed(lines: DataFrame) -> DataFrame:
    """(node, n, bands, signature) of lines (node, line), where a node may stand in n rows. The signature holds four bits of each of the first minima."""
    # numbers only, so that the minima of a task are kept in a hash table and no text is dealt out
    minima = [F.min(F.least(*(F.col(f"h{j}_{r}").bitwiseXOR(_order(b, r)) for j in range(_AT_ONCE)))).alias(f"m{b * ROWS + r}") for b in range(BANDS) for r in range(ROWS)]
    found = _hashed(lines).groupBy("node").agg(F.count_if(F.col("at") == 0).alias("n"), *minima)
    bands = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)]
    four = [F.shiftleft(F.hash(f"m{i}").bitwiseAND(F.lit(15)).cast("long"), 4 * (i % PER_LONG)) for i in range(MARKED)]
    longs = [reduce(lambda x, y: x.bitwiseOR(y), four[at : at + PER_LONG]) for at in range(0, MARKED, PER_LONG)]
    return found.select("node", "n", F.array(*bands).alias("bands"), F.array(*longs).alias("signature"))


def _alike(similarity: float):
    """Whether two signatures differ in as few bits as those of a linked pair do, but for one linked pair in some thousands."""
    apart = 1 - similarity
    # two of the four bits of minima that differ, with a variance of one
    most = math.ceil(2 * MARKED * apart + 3.5 * math.sqrt(MARKED * (5 * apart - (2 * apart) ** 2)))
    bits = (F.bit_count(F.get("signature_a", F.lit(i)).bitwiseXOR(F.get("signature_b", F.lit(i)))) for i in range(MARKED // PER_LONG))
    return reduce(lambda x, y: x + y, bits) <= most


def line_components(lines: DataFrame, signatures: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the nodes with a verified link; lines: (node, line) of the nodes of the buckets, where nodes may repeat. To be called in scratch()."""
    lines = written(lines.dropDuplicates(["node"]), "lines")
    centred = written(linking.central(buckets), "line-centres")
    removed(buckets)

    def verified(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(lines.select(F.col("node").alias(x), F.col("line").alias(f"line_{x}")), x)
        sets = pairs.select("a", "b", *(_shingle_set(F.col(f"line_{x}")).alias(x * 2) for x in "ab"))
        counts = sets.select("a", "b", (F.size("aa") + F.size("bb")).alias("all"), F.size(F.array_intersect("aa", "bb")).alias("shared"))
        # shared / (all - shared) >= similarity, without a division
        return counts.where(F.col("shared") * F.lit(1 + similarity) >= F.lit(similarity) * F.col("all") - F.lit(1e-9)).select("a", "b")

    first = written(linking.likely(linking.first_pairs(centred), signatures, _alike(similarity)), "line-pairs")
    first = written(verified(first), "line-links")
    finer = [F.expr(f"signature[{i}] >> {32 * j} & 4294967295L") for i in range(MARKED // PER_LONG) for j in range(2)]
    shingles = lambda nodes: lines.join(nodes, "node", "left_semi").select("node", F.explode(_shingle_set(F.col("line"))).alias("shingle"), F.lit(1).alias("weight"))
    return linking.linked_components(centred, signatures, first, verified, _alike(similarity), finer, shingles, similarity, "line")


def removed_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, drop): for each key of docs (key, text) that loses lines, the numbers of these lines, from 0."""
    found = _lines(docs, min_chars)
    with scratch() as kept:
        with scratch() as chosen:
            signed = written(_signed(found.select("node", "line")), "line-signatures")
            buckets = chosen(linking.shared_buckets(signed.select(F.explode("bands").alias("bucket"), "node")), "line-buckets")
            near = written(buckets.select("node").distinct(), "line-near")
            signatures = chosen(signed.select("node", "signature").join(near, "node", "left_semi"), "line-bits")
            # a node with one place and no bucket in common loses nothing
            wanted = near.select("node", F.lit(True).alias("near")).unionAll(signed.where("n > 1").select("node", F.lit(False)))
            wanted = wanted.groupBy("node").agg(F.max("near").alias("near"))
            # no texts are sorted
            places = found.join(wanted.hint("shuffle_hash"), "node").select("node", "key", "at", F.when(F.col("near"), F.col("line")).alias("line"))
            places = chosen(places, "line-places")
        with scratch() as linked:
            # what the components were found by goes here
            joined = linked(line_components(places.where("line is not null").select("node", "line"), signatures, buckets, similarity), "line-joined")
        removed(signatures)
        again = places.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.col("node").alias("component"))
        every = joined.unionAll(again.join(joined, "node", "left_anti"))
        copies = written(places.select("node", "key", "at").join(every, "node").select("component", "key", "at"), "line-copies")
        removed(joined, places)
        heads = written(copies.groupBy("component").agg(F.min(F.struct("key", "at")).alias("head")), "line-heads")
        gone = copies.join(heads, "component").where((F.col("key") != F.col("head.key")) | (F.col("at") != F.col("head.at")))
        return kept(gone.groupBy("key").agg(F.collect_set("at").alias("drop")), "line-drops")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) as (row, text, n_lines, n_removed): all columns in `row`, and the new text."""
    key = F.coalesce("doc_id", F.lit(_LOWEST)).alias("key")
    gone = removed_lines(docs.select(key, "text"), **options)
    # the text goes through the shuffle once, and no whole texts are sorted
    both = docs.select(F.struct(*docs.columns).alias("row"), key).join(gone.hint("shuffle_hash"), "key", "left").withColumn("text", F.col("row").getField("text"))
    lines = F.split("text", "\n")
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)))
    both = both.select("row", F.size(lines).alias("n"), kept.alias("kept"), F.col("text").isNull().alias("none"), "text", "drop")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    counts = (F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long"), F.when(F.col("none"), 0).otherwise(F.col("n") - F.size("kept")).cast("long"))
    return both.select("row", text.alias("text"), counts[0].alias("n_lines"), counts[1].alias("n_removed"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document: doc_id, n_lines, n_removed and the text that is left."""
    return dedup_lines(documents(spark, sf_dir)).select("row.doc_id", "n_lines", "n_removed", "text")
