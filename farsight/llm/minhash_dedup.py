"""Near-duplicate classes by DartMinHash over weighted word shingles.

A text is the multiset of its runs of five words (lower case, words of letters, digits and "_"; a text of one to
four words is one run). Each weighted shingle is a region of weight by time into which hashed darts fall as a
Poisson process; a dart names a coordinate, and each coordinate of the signature keeps its earliest dart. About
k log k darts fill a signature whatever the size of the text. Signatures are banded; buckets give candidate
links (see linking), and each link is verified on the exact weighted Jaccard likeness. Classes are components of
the verified links; equal texts are one node from the start.

Defined results: a null or empty text, or one without words, is alone in its class; a null doc_id is kept and
counts as the smallest id; rows that repeat a doc_id are judged one by one, so the class of a repeated doc_id is
that of each row's own text; an empty table gives no rows; further columns of the input are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.llm import linking
from farsight.llm.shared import documents, removed, scratch, sliced, small_batches, text_or_empty, written
from farsight.llm.textnum import SPACES_AND_MARKS, Words, chunks, mix

_U = np.uint64
WORDS = 5
BANDS, ROWS = 24, 5
SIMILARITY = 0.8
#: Stands for a null doc_id in keys.
_LOWEST = -(1 << 63)
#: What SPACES_AND_MARKS leaves in a word.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"
_BLOCK = 32
#: Coordinates of which a long of the signature holds two bits each.
PER_LONG = 30


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(hashes: np.ndarray, weights: np.ndarray, text: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n by k, times of the earliest darts) of n weighted sets; element i has a hash, a weight and a set `text[i]`.

    The weight axis is cut into dyadic cells, [0, 1), [1, 2), [2, 4), ...; a dart in the last, partly filled cell
    counts only below the weight. A set without elements keeps infinite times.
    """
    signature = np.full(n * k, np.inf)
    if not len(hashes):
        return signature.reshape(n, k)
    cells = np.maximum(np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64), 0) + 1
    of = np.repeat(np.arange(len(hashes)), cells)
    level = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix(hashes[of] + level.astype(_U) * _U(0x9E3779B97F4A7C15))
    home, most = text[of] * k, weights[of]
    until = k * (math.log(k) + 3) / np.maximum(np.bincount(text, weights, n), 1e-300)
    todo = np.ones(n, bool)
    while True:
        live = np.flatnonzero(todo[text[of]])
        time, dart = np.zeros(len(live)), np.zeros(len(live), _U)
        while len(live):
            block = _BLOCK if len(live) < 4096 else 1
            draw = mix(seed[live][:, None] + (dart[:, None] + np.arange(1, block + 1, dtype=_U)) * _U(0xD1342543DE82EF95))
            times = -np.log(_uniform(draw)) / width[live][:, None]
            # summed dart by dart from the first one: a time never depends on the blocks, so not on the other texts
            times[:, 0] += time
            times = np.cumsum(times, axis=1)
            place = mix(draw ^ _U(0xA0761D6478BD642F))
            hit = times < until[text[of[live]]][:, None]
            partly = low[live] > 0
            if partly.any():
                at = low[live][:, None] + _uniform(mix(place)) * width[live][:, None]
                counts = hit & (~partly[:, None] | (at < most[live][:, None]))
            else:
                counts = hit
            row, column = np.nonzero(counts)
            np.minimum.at(signature, home[live[row]] + (place[row, column] % _U(k)).astype(np.int64), times[row, column])
            on = hit[:, -1]
            live, time, dart = live[on], times[on, -1], dart[on] + _U(block)
        filled = np.isfinite(signature).reshape(n, k).all(axis=1)
        todo = ~filled & (np.bincount(text, minlength=n) > 0)
        if not todo.any():
            return signature.reshape(n, k)
        until[todo] *= 2


def _counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: hashes, counts, texts; sorted by text, then hash."""
    hashes, text = words.shingles(WORDS)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(hashes) else np.empty(0, np.int64)
    return hashes[new], np.diff(np.append(new, len(hashes))), text[new]


def _words(texts: list[str | None]) -> Words:
    return Words([(t or "").lower().encode() for t in texts], SPACES_AND_MARKS, by_place=True)


def _node(words: Words) -> np.ndarray:
    """A hash of all words of each text, which is its node."""
    return words.whole.view(np.int64)


def sketch(docs: DataFrame, k: int = BANDS * ROWS, rows: int = ROWS) -> DataFrame:
    """(key, node, words, bands, signature) of docs (key, text).

    bands hold hashes of `rows` coordinates; the signature is longs of two bits of each of PER_LONG coordinates.
    """
    longs = -(-k // PER_LONG)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            keys, texts = batch.column("key"), batch.column("text").to_pylist()
            for a, b in chunks(texts, 1 << 19):
                words = _words(texts[a:b])
                hashes, counts, text = _counted(words)
                times = dart_minhash(hashes, counts.astype(np.float64), text, b - a, k).view(_U)
                folded = np.arange(k // rows, dtype=_U) * _U(0x9E3779B97F4A7C15) + np.zeros((b - a, 1), _U)
                for r in range(rows):
                    folded = mix(folded ^ times[:, r::rows][:, : k // rows])
                at = pa.array(np.arange(0, (b - a) * (k // rows) + 1, k // rows, dtype=np.int32))
                bands = pa.ListArray.from_arrays(at, pa.array(folded.ravel().view(np.int64)))
                two = np.zeros((b - a, longs * PER_LONG), _U)
                two[:, :k] = mix(times) >> _U(62)
                packed = (two.reshape(b - a, longs, PER_LONG) << (2 * np.arange(PER_LONG, dtype=_U))).sum(axis=2, dtype=_U)
                signature = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * longs + 1, longs, dtype=np.int32)), pa.array(packed.ravel().view(np.int64)))
                columns = [keys.slice(a, b - a), pa.array(_node(words)), pa.array(words.count.astype(np.int64)), bands, signature]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "words", "bands", "signature"])

    small_batches(docs.sparkSession)
    return docs.select("key", "text").mapInArrow(batches, "key long, node long, words long, bands array<long>, signature array<long>")


def shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes, counts), packed, of the nodes in `wanted` (key, node), from the text of one of their documents."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            nodes, texts = batch.column("node").to_numpy(), batch.column("text").to_pylist()
            for a, b in chunks(texts, 1 << 19):
                words = _words(texts[a:b])
                hashes, counts, text = _counted(words)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                own = np.flatnonzero(_node(words) == nodes[a:b])  # else another row with this doc_id
                parts = [(hashes[cut[i] : cut[i + 1]].tobytes(), counts[cut[i] : cut[i + 1]].astype(np.uint32).tobytes()) for i in own]
                columns = [pa.array(nodes[a:b][own]), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes", "counts"])

    made = docs.join(wanted, "key").select("node", "text").mapInArrow(batches, "node long, hashes binary, counts binary")
    return made.dropDuplicates(["node"])


def weighted_shingles(shingles: DataFrame) -> DataFrame:
    """(node, shingle, weight) from a table of packed ones."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it, 100):
            hashes, counts = ([np.frombuffer(x, kind) for x in batch.column(c).to_pylist()] for c, kind in (("hashes", np.int64), ("counts", np.uint32)))
            if hashes:
                node = np.repeat(batch.column("node").to_numpy(), [len(h) for h in hashes])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(counts).astype(np.int64))], names=["node", "shingle", "weight"])

    return shingles.select("node", "hashes", "counts").mapInArrow(batches, "node long, shingle long, weight long")


def likeness(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray) -> float:
    """Weighted Jaccard likeness of two multisets given as sorted hashes and counts."""
    at = np.searchsorted(hb, ha)
    same = at < len(hb)
    same[same] = hb[at[same]] == ha[same]
    least = np.minimum(ca[same], cb[at[same]]).sum(dtype=np.int64)
    return float(least / (ca.sum(dtype=np.int64) + cb.sum(dtype=np.int64) - least))


def verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes with at least this likeness."""

    def judged(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            keep = [
                likeness(np.frombuffer(ha, _U), np.frombuffer(ca, np.uint32), np.frombuffer(hb, _U), np.frombuffer(cb, np.uint32)) >= similarity
                for ha, ca, hb, cb in zip(batch["ha"], batch["ca"], batch["hb"], batch["cb"], strict=True)
            ]
            yield batch.loc[keep, ["a", "b"]]

    a, b = (shingles.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"), F.col("counts").alias(f"c{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "ca", "hb", "cb").mapInPandas(judged, "a long, b long")


def _alike(k: int, similarity: float):
    """Whether two signatures differ in as few bits as those of a linked pair do, but for one linked pair in some thousands."""
    apart = 1 - similarity
    most = math.ceil(k * apart + 3.7 * math.sqrt(k * (1.5 * apart - apart**2)))
    bits = (F.bit_count(F.get("signature_a", F.lit(i)).bitwiseXOR(F.get("signature_b", F.lit(i)))) for i in range(-(-k // PER_LONG)))
    return reduce(lambda x, y: x + y, bits) <= most


def duplicate_classes(docs: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, class_id, class_size) for every row of `docs` (doc_id, text); class_id is the smallest doc_id of the class."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), text_or_empty().alias("text"))
    with scratch() as kept:
        sketched = written(sketch(keyed, bands * rows, rows), "sketches")
        some = sketched.where("words > 0")
        nodes = written(some.groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "nodes")
        known = written(sketched.select("key", F.when(F.col("words") > 0, F.col("node")).alias("node")), "keys")
        removed(sketched)
        buckets = written(linking.shared_buckets(nodes.select(F.explode("bands").alias("bucket"), "node")), "shared")
        centred = written(linking.central(buckets), "buckets")
        removed(buckets)
        signatures = nodes.select("node", "signature")

        with scratch() as linked:
            wanted = centred.select("node").distinct().join(nodes.select("node", "key"), "node")
            shingles = written(shingle_table(keyed, wanted), "shingles")
            links = written(verified(written(linking.first_pairs(centred), "pairs"), shingles, similarity), "links")
            # ten coordinates of the signature make a part
            finer = [F.expr(f"(signature[{i}] >> {20 * j}) & 1048575L") for i in range(bands * rows // PER_LONG) for j in range(2)]
            joined = linking.linked_components(
                centred, signatures, links, lambda pairs: verified(pairs, shingles, similarity), _alike(bands * rows, similarity), finer,
                lambda nodes: weighted_shingles(shingles.join(nodes, "node", "left_semi")), similarity, "near",
            )
            joined = linked(joined, "joined")
        classes = nodes.select("node", "key", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = classes.groupBy("component").agg(F.min("key").alias("head"), F.sum("copies").alias("class_size"))
        heads = classes.join(heads, "component").select("node", "head", "class_size")
        found = kept(known.join(heads, "node", "left"), "classes")
    plain = lambda c: F.nullif(c, F.lit(_LOWEST))
    return found.select(plain(F.col("key")).alias("doc_id"), "node", plain(F.coalesce("head", "key")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each class: that of the class's smallest doc_id. Rows without words all stay."""

    @F.pandas_udf("long")
    def node_of(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts), np.int64)
        for a, b in chunks(values := texts.tolist(), 1 << 19):
            out[a:b] = _node(_words(values[a:b]))
        return pd.Series(out)

    found = duplicate_classes(docs, **options)
    stay = found.where(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key_"), F.col("node").alias("node_")).distinct()
    empty = ~text_or_empty().rlike(_WORD)
    rows = docs.where(~empty).withColumn("node_", node_of(text_or_empty())).withColumn("key_", F.coalesce("doc_id", F.lit(_LOWEST)))
    kept = rows.join(stay, ["key_", "node_"]).dropDuplicates(["key_", "node_"]).select(docs.columns)
    return kept.unionAll(docs.where(empty))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document its class: (doc_id, class_id, class_size)."""
    return duplicate_classes(documents(spark, sf_dir)).drop("node")
