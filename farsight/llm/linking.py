"""Classes from buckets, without all pairs of a bucket, by one rule for buckets of every size.

1. Members of a bucket are compared with its most central member.
2. Of buckets where some members are then outside the component of the central one, all members are cut finer by
   parts of their signatures and compared with one member of each part.
3. What is still of different components in one bucket is compared by signature, in blocks: members outside the
   central component with all others. No member of a bucket is left out, whatever its size, and a hot bucket is spread
   over many tasks. Members with a partner then meet on their rarest shingles: with shingles in order of how many of
   them hold each, two sets that are alike enough share one early in both. This bound is exact, and a family whose
   members share no more than their common original makes few pairs.

The first two rounds make as many pairs as members; what they join, the third need not look at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.llm.components import components
from farsight.llm.shared import scratch, written

#: Members of a block of a bucket; a task compares two blocks at a time.
BLOCK = 2048


def shared_buckets(members: DataFrame) -> DataFrame:
    """Rows (bucket, node) of buckets with at least two nodes, with `size`."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes, "bucket")


def central(buckets: DataFrame) -> DataFrame:
    """`buckets` with `centre`: the node of each bucket that stands in the fullest buckets (ties: the smallest)."""
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = buckets.join(weight, "node")
    best = weighed.groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("weight"), "node")).alias("centre"))
    return buckets.join(best, "bucket")


def first_pairs(centred: DataFrame) -> DataFrame:
    """(a, b): each member with the centre of its bucket."""
    return centred.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()


def likely(pairs: DataFrame, signatures: DataFrame, alike: Column) -> DataFrame:
    """The pairs (a, b) that meet `alike` on signature_a and signature_b."""
    for x in "ab":
        pairs = pairs.join(signatures.select(F.col("node").alias(x), F.col("signature").alias(f"signature_{x}")), x)
    return pairs.where(alike).select("a", "b")


def split_buckets(centred: DataFrame, component_of: DataFrame) -> DataFrame:
    """(bucket, node, component, away) without centres, of buckets where some are `away` from the centre's component.

    component_of: (node, component) for linked nodes; others stand alone.
    """
    homes = component_of.select(F.col("node").alias("centre"), F.col("component").alias("home"))
    known = centred.where("node <> centre and size > 2").join(component_of, "node", "left").join(homes, "centre", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    known = known.withColumn("away", F.col("component") != F.coalesce("home", "centre")).select("bucket", "node", "centre", "size", "component", "away")
    some = known.where("away").select("bucket").distinct()
    return known.join(some, "bucket", "left_semi")


def finer_pairs(split: DataFrame, signatures: DataFrame, finer: list[Column]) -> DataFrame:
    """(a, b): members of split buckets with the first of their part of the bucket, for each of the columns `finer` of the signature."""
    parts = F.array(*(F.xxhash64("bucket", F.lit(i), f) for i, f in enumerate(finer)))
    cut = split.join(signatures, "node").select("node", "component", F.explode(parts).alias("part"))
    heads = cut.groupBy("part").agg(F.min("node").alias("head"), F.min_by("component", "node").alias("of"), F.count("*").alias("n")).where("n > 1")
    return cut.join(heads, "part").where("component <> of").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()


def hopeful(split: DataFrame, signatures: DataFrame, alike: Column) -> DataFrame:
    """(node): members of split buckets with any partner of another component that meets `alike`; as many rows as members at most.

    Members are dealt to blocks by hash; each block of members that are away meets each block of the bucket.
    """
    sizes = split.groupBy("bucket").agg(F.count("*").alias("n_all"), F.count_if("away").alias("n_away"))
    known = split.select("bucket", "node", "component", "away").join(sizes, "bucket").join(signatures, "node")
    blocks = {"x": F.ceil(F.col("n_away") / BLOCK), "y": F.ceil(F.col("n_all") / BLOCK)}
    own = {c: F.pmod(F.xxhash64("node"), n) for c, n in blocks.items()}
    each = {c: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)) for c, n in blocks.items()}
    columns = ["bucket", "node", "component", "signature"]
    left = known.where("away").select(*columns, own["x"].alias("x"), each["y"].alias("y"))
    right = known.where("n_away > 0").select(*columns, each["x"].alias("x"), own["y"].alias("y"))
    a, b = (x.select(*(F.col(c).alias(f"{c}_{n}") for c in x.columns)) for x, n in ((left, "a"), (right, "b")))
    on = (F.col("component_a") != F.col("component_b")) & alike
    for c in ("bucket", "x", "y"):
        on = (F.col(f"{c}_a") == F.col(f"{c}_b")) & on
    return a.join(b, on, "left_semi").select(F.col("node_a").alias("node")).unionAll(b.join(a, on, "left_semi").select("node_b")).distinct()


def early_shingles(shingles: DataFrame, similarity: float) -> DataFrame:
    """(node, shingle, all, rest): the shingles that an alike set must share one of. shingles: (node, shingle, weight), distinct.

    Shingles of a node stand in the order of how many nodes hold each; `all` is the weight of a node, `rest` that from
    this shingle on. What two sets share is at most the lesser rest at the first shingle that they share.
    """
    holders = shingles.groupBy("shingle").agg(F.count("*").alias("n"))
    own = Window.partitionBy("node")
    # a sum up to the row: one from the row on is added up anew for each row
    until = F.sum("weight").over(own.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = F.sum("weight").over(own)
    ranked = shingles.join(holders, "shingle").select("node", "shingle", "n", every.alias("all"), (every - until + F.col("weight")).alias("rest"))
    return ranked.where((F.col("n") > 1) & (F.col("rest") >= F.lit(similarity) * F.col("all") - F.lit(1e-9))).drop("n")


def rest_pairs(split: DataFrame, early: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of members of split buckets, of different components and one of them away, whose early_shingles() allow the similarity."""
    facts = split.groupBy("node").agg(F.max("component").alias("component"), F.max("away").alias("away"))
    known = early.join(facts, "node")
    a, b = (known.select(*(F.col(c).alias(f"{c}_{n}") for c in known.columns)) for n in "ab")
    # shared >= similarity / (1 + similarity) x (both weights) is what the similarity asks for
    can = F.least("rest_a", "rest_b") * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("all_a") + F.col("all_b")) - F.lit(1e-9)
    once = (F.col("node_a") < F.col("node_b")) | ~F.col("away_b")
    pairs = a.where("away_a").join(b, (F.col("shingle_a") == F.col("shingle_b")) & (F.col("component_a") != F.col("component_b")) & once & can)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def linked_components(
    centred: DataFrame, signatures: DataFrame, first: DataFrame, verified: Callable[[DataFrame], DataFrame], alike: Column, finer: list[Column],
    shingles_of: Callable[[DataFrame], DataFrame], similarity: float, name: str,
) -> DataFrame:
    """(node, component) of all nodes with a verified link, by the three rounds above.

    first: the verified links of the first round; verified: the links among pairs (a, b); shingles_of: (node, shingle,
    weight) of given nodes.
    """
    joined = components(first, f"{name}-components")
    split = written(split_buckets(centred, joined), f"{name}-split")

    def heads() -> DataFrame:
        return likely(finer_pairs(split, signatures, finer), signatures, alike)

    def rest() -> DataFrame:
        left = written(hopeful(split, signatures, alike), f"{name}-hopeful")
        early = written(early_shingles(shingles_of(left), similarity), f"{name}-early")
        return likely(rest_pairs(split, early, similarity), signatures, alike)

    for pairs in (heads, rest):
        if split.isEmpty():
            break
        with scratch() as kept:
            found = kept(verified(written(pairs(), f"{name}-pairs")), f"{name}-links")
        if not found.isEmpty():
            # the stars of before stand for the links that made them
            stars = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            joined = components(stars.unionAll(found), f"{name}-components")
            if pairs is heads:
                split = written(split_buckets(split.select("bucket", "node", "centre", "size"), joined), f"{name}-split")
    return joined
