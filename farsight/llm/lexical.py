"""Ranked lexical search with block-max pruning.

A scan of the documents cuts every whole text into terms and keeps, for each document, its number of terms and the
query terms it holds: a forward index. Consecutive documents make blocks, which hold each document's impacts by term and
the largest impact of each term. The sum of these maxima bounds the score of every document of the block, so the blocks
of a query are taken in the order of their bounds, and scored until no bound reaches the score of the k-th document
found. Blocks go in rounds that grow by a factor, all queries at once.

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased.
Terms are compared by their bytes; hashes only lead to the one to compare.

Defined results: null and empty texts have no terms; rows that repeat a doc_id are documents of their own; a null doc_id
comes after all others among equal scores; the rows of one item_id (null too) are one item with all their terms; an item
without terms, or without any document that holds one, has no rows; further input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farsight.llm.shared import documents, written
from farsight.llm.textnum import _BYTE, gathered, ranges

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters of the items whose terms are broadcast with one scan of the documents.
ITEM_BLOCK = 4_000_000
#: Documents of a block, blocks of each query in the first round, and how many times more each further round takes.
BLOCK_DOCS, FIRST, GROWTH = 64, 16, 8

_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)
_WORD = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)


class Vocabulary:
    """The distinct terms of a block of queries, found in texts by hash and then by their bytes."""

    def __init__(self, terms: list[str]):
        self.terms = [t.encode() for t in terms]

    def __getstate__(self):
        return {"terms": self.terms}

    @cached_property
    def by_hash(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, the number of each one's term, all bytes, and where the bytes of a number begin."""
        data = np.frombuffer(b"".join(self.terms) or b"\0", np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in self.terms])]).astype(np.int64)
        hashes = ranges(_BYTE[data], at[:-1], at[1:])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], order, data, at

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.terms)}

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each of the terms data[start:end], -1 where it is none of these."""
        if not self.terms:
            return np.full(len(start), -1)
        hashes, order, own, at = self.by_hash
        h = ranges(_BYTE[data], start, end)
        near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        out = np.where(hashes[near] == h, order[near], -1)
        hit = np.flatnonzero(out >= 0)
        same = end[hit] - start[hit] == at[out[hit] + 1] - at[out[hit]]
        whole = hit[same]
        a, first = gathered(data, start[whole], end[whole])
        b, _ = gathered(own, at[out[whole]], at[out[whole] + 1])
        if len(whole):
            same[same] = np.add.reduceat((a != b).astype(np.int64), first[:-1]) == 0
        for i in hit[~same]:
            out[i] = self.numbers.get(data[start[i] : end[i]].tobytes(), -1)
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and where each text begins (and the last ends)."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and start, end and text of each term of texts data[at[i]:at[i + 1]]."""
    low = _LOWER[data]
    word = _WORD[low]
    inside = np.zeros(len(word) + 1, bool)  # whether a byte and the one before it are of one term
    inside[1:-1] = word[1:] & word[:-1]
    inside[at] = False
    start, end = np.flatnonzero(word & ~inside[:-1]), np.flatnonzero(word & ~inside[1:]) + 1
    return low, start, end, np.searchsorted(at, start, "right") - 1


def counted(texts: pa.Array, vocabulary: Vocabulary, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts [a, b) of about `limit` bytes: terms of each text, and text, number and count of query terms in it."""
    data, at = text_bytes(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        low, start, end, text = terms_of(data[at[a] : at[b]], at[a : b + 1] - at[a])
        number = vocabulary.find(low, start, end)
        hit = number >= 0
        width = max(1, len(vocabulary.terms))
        key, tf = np.unique(text[hit] * width + number[hit], return_counts=True)
        yield a, b, np.bincount(text, minlength=b - a), key // width, key % width, tf
        a = b


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """`values` as n lists by their owner, which is in order."""
    at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def forward_index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of every row of docs (doc_id, text): all its terms counted, query terms listed by number."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n, text, number, tf in counted(batch.column("text"), held.value):
                lists = (_lists(number, text, b - a, pa.int32()), _lists(tf, text, b - a, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, n long, terms array<int>, counts array<int>")


_BLOCK = "block long, doc_ids array<long>, docs array<int>, terms array<int>, impacts array<long>, max_terms array<int>, max_impacts array<long>"


def _impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def blocks_of(forward: DataFrame, n_docs: int, n_terms: int, size: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of `size` consecutive documents that hold query terms: the impacts in each document, and the largest by term."""

    def made(number: int, ids: pa.Array, n: np.ndarray, at: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(n)), np.diff(at))
        impact = _impacts(tf, n[doc], n_docs, n_terms)
        order = np.lexsort((-impact, terms))
        first = np.concatenate([[True], np.diff(terms[order]) > 0])
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        columns = [pa.array([number], pa.int64()), one(ids, pa.int64()), one(doc, pa.int32()), one(terms, pa.int32()), one(impact, pa.int64()), one(terms[order][first], pa.int32()), one(impact[order][first], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "docs", "terms", "impacts", "max_terms", "max_impacts"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rest = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            while table.num_rows >= size:
                yield whole(number, table.slice(0, size))
                table, number = table.slice(size), number + 1
            rest = table if table.num_rows else None
        if rest is not None:
            yield whole(number, rest)

    def whole(number: int, part: pa.Table) -> pa.RecordBatch:
        (part,) = part.combine_chunks().to_batches()
        terms, counts = part.column("terms"), part.column("counts")
        at = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
        return made(number, part.column("doc_id"), part.column("n").to_numpy(), at, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64))

    return forward.where(F.size("terms") > 0).mapInArrow(pack, _BLOCK)


class Queries:
    """A block of items by number: their term numbers and weights, by item and by term."""

    def __init__(self, terms_by_item: list[np.ndarray], weights: np.ndarray):
        self.n = len(terms_by_item)
        term = np.concatenate([*terms_by_item, np.zeros(0, np.int64)]).astype(np.int64)
        item = np.repeat(np.arange(self.n), [len(t) for t in terms_by_item])
        order = np.argsort(term, kind="stable")
        self.item, self.weights = item[order], weights
        self.at = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items that hold each of `terms`, one after the other, and the index of the term for each."""
        items, at = gathered(self.item, self.at[terms], self.at[terms + 1])
        return items, np.repeat(np.arange(len(terms)), np.diff(at))


def _bounds(blocks: DataFrame, held) -> DataFrame:
    """(item, block, bound) for the items that share a term with a block."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for batch in batches:
            rows = []
            for block, terms, most in zip(batch.column("block").to_numpy(), batch.column("max_terms"), batch.column("max_impacts"), strict=True):
                terms, most = terms.values.to_numpy().astype(np.int64), most.values.to_numpy()
                items, of = q.of(terms)
                sums = np.bincount(items, weights=(q.weights[terms] * most)[of], minlength=q.n)  # whole numbers below 2**53
                some = np.flatnonzero(sums)
                rows.append((some, np.full(len(some), block), sums[some].astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "block", "bound"])

    return blocks.select("block", "max_terms", "max_impacts").mapInArrow(bound, "item int, block long, bound long")


def _scores(asked: DataFrame, held, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each block for each item that asks for it (column items)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for batch in batches:
            out = []
            for ids, docs, terms, impacts, items in zip(*(batch.column(c) for c in ("doc_ids", "docs", "terms", "impacts", "items")), strict=True):
                docs, terms, impacts = (x.values.to_numpy().astype(np.int64) for x in (docs, terms, impacts))
                items = np.unique(items.values.to_numpy())
                held_by, of = q.of(terms)
                at = np.minimum(np.searchsorted(items, held_by), len(items) - 1)
                mine = items[at] == held_by
                at, of = at[mine], of[mine]
                n = len(ids.values)
                sums = np.bincount(at * n + docs[of], weights=(q.weights[terms] * impacts)[of], minlength=n * len(items)).astype(np.int64)
                found = np.flatnonzero(sums)
                known = ids.values.is_valid().to_numpy(zero_copy_only=False)
                own = ids.values.fill_null(0).to_numpy()
                item, doc = found // n, found % n
                order = np.lexsort((own[doc], ~known[doc], -sums[found], item))
                item, doc, found = item[order], doc[order], found[order]
                place = np.arange(len(item)) - np.searchsorted(item, item)
                some = place < k
                out.append(pa.RecordBatch.from_arrays([pa.array(items[item[some]], pa.int32()), ids.values.take(pa.array(doc[some])), pa.array(sums[found[some]], pa.int64())], ["item", "doc_id", "score"]))
            yield from out

    return asked.select("doc_ids", "docs", "terms", "impacts", "items").mapInArrow(score, "item int, doc_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_blocks(blocks: DataFrame, queries: Queries, k: int, *, first: int = FIRST, growth: int = GROWTH) -> tuple[DataFrame, list[int]]:
    """(item, doc_id, score, rank) of the k best documents of each item, and the block scorings of each round.

    A round takes, for each item, its next blocks in descending order of (bound, block) whose bound is not below the
    score of the k-th document found so far.
    """
    held = blocks.sparkSession.sparkContext.broadcast(queries)
    bounds = written(_bounds(blocks, held), "bounds")
    found, taken, rounds, take = None, None, [], first
    while True:
        left = bounds
        if found is not None:
            least = found.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
            last = taken.groupBy("item").agg(F.min(F.struct("bound", "block")).alias("last"))
            # an item that took no block in the last round has none left
            left = bounds.join(last, "item").join(least, "item", "left").where((F.struct("bound", "block") < F.col("last")) & (F.col("bound") >= F.coalesce("least", F.lit(1))))
        order = Window.partitionBy("item").orderBy(F.desc("bound"), F.desc("block"))
        taken = written(left.select("item", "block", "bound", F.row_number().over(order).alias("place")).where(F.col("place") <= take), "blocks-taken")
        n = taken.count()
        if not n:
            return (found if found is not None else blocks.sparkSession.createDataFrame([], "item int, doc_id long, score long, rank int")), rounds
        rounds.append(n)
        asked = blocks.join(taken.groupBy("block").agg(F.collect_list("item").alias("items")), "block")
        rows = _scores(asked, held, k)
        if found is not None:
            rows = found.select("item", "doc_id", "score").unionAll(rows)
        found, take = written(_best(rows, k), "ranked"), take * growth


def _item_blocks(items: DataFrame, limit: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and distinct terms of the items, in blocks of about `limit` characters of text."""
    lower = F.translate(F.col("term"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select("item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), 0)).alias("term")).select("item_id", lower.alias("term")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // limit)
    for part in range(parts):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id").collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["terms"] for r in rows]


def weight(n_docs: int, holding: int) -> int:
    """What a term counts that `holding` of so many documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, *, item_block: int = ITEM_BLOCK, block_docs: int = BLOCK_DOCS, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) with a score above 0 for each of items (item_id, text)."""
    spark = docs.sparkSession
    out = []
    for ids, terms in _item_blocks(items.select("item_id", "text"), item_block):
        vocabulary = sorted({t for ts in terms for t in ts})
        number = {t: i for i, t in enumerate(vocabulary)}
        forward = written(forward_index(docs, Vocabulary(vocabulary)), "forward")
        n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r["term"]: r["df"] for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # query terms only
        weights = np.array([weight(n_docs, holding[i]) if i in holding else 0 for i in range(len(vocabulary))], np.int64)
        blocks = written(blocks_of(forward, n_docs, n_terms, block_docs), "blocks")
        queries = Queries([np.array([number[t] for t in ts], np.int64) for ts in terms], weights)
        found, _ = search_blocks(blocks, queries, k, first=first, growth=growth)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    kind = items.schema["item_id"].dataType.simpleString()
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""WITH words AS (SELECT row_number() OVER () AS doc, doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
d AS (SELECT doc, doc_id, len(terms) AS n, terms FROM words WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
t AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY doc, term),
q AS (SELECT DISTINCT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM
(SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT doc, doc_id, 10 + ((90 * n * n_docs) // n_terms) AS m FROM d, s),
scored AS (SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc) GROUP BY item_id, doc, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
