"""Substring dedup by difference-cover anchors.

Every run of 20 words that also starts earlier (smaller doc_id, or earlier in the same document) is found, and
the words that such runs cover are removed. Only words at positions in a difference cover modulo 13 start an
anchor of 8 words: for any two positions some shift below 13 brings both into the cover, so two equal runs of
20 words share an aligned anchor. Runs are hashed only around anchors that occur twice.

Tasks fold what repeats within a batch of documents before the shuffle, so that a run that very many documents
share reaches the common task once for each batch.

Defined results: a null text has no words; a null doc_id comes before all others; rows that repeat a doc_id are
judged one by one, where two of them have equal runs at the same place neither is the earlier one, and fully
equal rows get equal results; texts of under 20 words lose nothing. Further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.llm.shared import documents, shuffle_partitions, sliced, text_or_empty, written
from farsight.llm.textnum import Words, chunks

WINDOW = 20
#: A difference cover modulo 13: each residue but 0 is the difference of one pair. Fixed values.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Groups of hashes for each shuffle partition; a group is held whole in one task.
GROUPS = 4
_LOWEST = -(1 << 63)
_FOUND = "group long, hash binary, doc binary, row binary, at binary, known boolean"


def _found_rows(hashes, docs, rows, at, groups: int, keep_first: bool) -> Iterator[dict]:
    """Rows of _FOUND for the places of one batch: one for each group of hashes, and one of places known to repeat.

    keep_first: the first place of a hash that repeats within the batch is itself wanted (an anchor); else only the
    later ones are (a run whose earlier copy stands in the same batch).
    """
    if not len(hashes):
        return
    order = np.lexsort((at, docs, hashes))
    hashes, docs, rows, at = hashes[order], docs[order], rows[order], at[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    if keep_first:
        start = np.flatnonzero(first)
        twice = np.repeat(np.diff(np.append(start, len(hashes))) > 1, np.diff(np.append(start, len(hashes))))
        known = twice
    else:
        head = np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
        known = (docs > docs[head]) | ((docs == docs[head]) & (at > at[head]))
        first = ~known  # copies at the same place of rows with one doc_id all compete
    if known.any():
        yield _packed(int(hashes[known][0] % np.uint64(groups)), hashes[:0], docs[known], rows[known], at[known], True)
    hashes, docs, rows, at = hashes[first], docs[first], rows[first], at[first]
    group = (hashes % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((at, docs, group))  # by document, so that neighbours are alike and compress
    ends = np.flatnonzero(np.diff(group[order], append=-1)) + 1
    start = 0
    for end in ends:
        some = order[start:end]
        yield _packed(int(group[some[0]]), hashes[some], docs[some], rows[some], at[some], False)
        start = end


def _packed(group: int, hashes, docs, rows, at, known: bool) -> dict:
    """One row of _FOUND; doc_ids as differences."""
    return {"group": group, "hash": hashes.tobytes(), "doc": np.diff(docs, prepend=0).tobytes(), "row": rows.tobytes(), "at": at.astype(np.uint32).tobytes(), "known": known}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("group", pa.int64()), *((c, pa.binary()) for c in ("hash", "doc", "row", "at")), ("known", pa.bool_())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _unpacked(table: pa.Table, what: str, kind) -> np.ndarray:
    parts = table.column(what).to_pylist()
    if what == "doc":
        return np.concatenate([np.cumsum(np.frombuffer(p, kind), dtype=kind) for p in parts]) if parts else np.empty(0, kind)
    return np.frombuffer(b"".join(parts), kind)


def _places(docs: np.ndarray, rows: np.ndarray, at: np.ndarray) -> pa.Table:
    """One row for each document of these places, with its places as an array."""
    order = np.lexsort((at, rows, docs))
    docs, rows, at = docs[order], rows[order], at[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1])]) if len(docs) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(docs)).astype(np.int32)), pa.array(at.astype(np.int32)))
    return pa.table({"key": pa.array(docs[start]), "row": pa.array(rows[start].astype(np.int64)), "at": lists})


_PLACES = "key long, row long, at array<int>"


def _repeated(found: DataFrame, keep_first: bool) -> DataFrame:
    """Places (key, row, at) whose hash repeats; without keep_first, only those after the first place."""

    def judged(table: pa.Table) -> pa.Table:
        sure = table.filter(table.column("known"))
        open_ = table.filter(pa.compute.invert(table.column("known")))
        hashes, docs, rows, at = (_unpacked(open_, c, k) for c, k in (("hash", np.uint64), ("doc", np.int64), ("row", np.uint32), ("at", np.uint32)))
        order = np.lexsort((at, docs, hashes))
        hashes, docs, rows, at = hashes[order], docs[order], rows[order], at[order]
        if len(hashes):
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(hashes)))
            if keep_first:
                want = np.repeat(size > 1, size)
            else:
                head = np.repeat(start, size)
                want = (docs > docs[head]) | ((docs == docs[head]) & (at > at[head]))
            docs, rows, at = docs[want], rows[want], at[want]
        return _places(*(np.concatenate([x, _unpacked(sure, c, k)]) for x, c, k in ((docs, "doc", np.int64), (rows, "row", np.uint32), (at, "at", np.uint32))))

    import pyarrow.compute  # noqa: F401  for pa.compute, in the task

    return found.groupBy("group").applyInArrow(judged, _PLACES)


def _row_hash(raw: bytes) -> int:
    """Tells rows with one doc_id apart."""
    return zlib.crc32(raw)


def _places_by_document(places: DataFrame) -> DataFrame:
    return places.groupBy("key", "row").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


def find_repeats(docs: DataFrame) -> DataFrame:
    """(key, row, at): for each document of `docs` (key, text) with such runs, where runs of 20 words start that also start earlier."""
    groups = GROUPS * shuffle_partitions(docs.sparkSession)

    def anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            keys, texts = batch.column("key").to_numpy(), batch.column("text").to_pylist()
            for a, b in chunks(texts, 1 << 19):
                raw = [t.encode() for t in texts[a:b]]
                words = Words(raw, by_place=True)
                hashes, at = words.windows(ANCHOR)
                place = at - words.first[words.text[at]]
                fits = np.isin(place % PERIOD, COVER) & (words.count[words.text[at]] >= WINDOW)
                hashes, at, place = hashes[fits], at[fits], place[fits]
                row = np.array([_row_hash(t) for t in raw], np.uint32)
                yield _batch(list(_found_rows(hashes, keys[a:b][words.text[at]], row[words.text[at]], place, groups, True)))

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            keys, rows, texts, places = batch.column("key").to_numpy(), batch.column("row").to_numpy().astype(np.uint32), batch.column("text").to_pylist(), batch.column("at").to_pylist()
            for a, b in chunks(texts, 1 << 19):
                words = Words([t.encode() for t in texts[a:b]], by_place=True)
                hashes, at = words.windows(WINDOW)
                near = np.zeros(len(words.hash) + 1, np.int32)  # how many repeated anchors a run may stand around
                for i, p in enumerate(places[a:b]):
                    p = np.asarray(p, np.int64)
                    np.add.at(near, words.first[i] + np.maximum(p - PERIOD + 1, 0), 1)
                    np.add.at(near, words.first[i] + p + 1, -1)
                wanted = np.cumsum(near)[at] > 0
                hashes, at = hashes[wanted], at[wanted]
                i = words.text[at]
                yield _batch(list(_found_rows(hashes, keys[a:b][i], rows[a:b][i], at - words.first[i], groups, False)))

    # nothing here keeps the plan of the anchors, so that their shuffle files can go
    around = written(_places_by_document(_repeated(docs.select("key", "text").mapInArrow(anchors, _FOUND), True)), "anchors")
    texts = _with_row(docs).join(around, ["key", "row"])
    return _places_by_document(_repeated(texts.mapInArrow(runs, _FOUND), False))


def _with_row(docs: DataFrame) -> DataFrame:
    """With `row`, as _row_hash gives it."""

    @F.pandas_udf("long")
    def row(texts: pd.Series) -> pd.Series:
        return pd.Series([_row_hash(t.encode()) for t in texts], dtype="int64")

    return docs.withColumn("row", row("text"))


def remove_repeats(docs: DataFrame, *, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and, with keep_text, `kept`: the kept words joined by one space."""
    docs = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), text_or_empty().alias("text"))
    repeats = written(find_repeats(docs), "repeats")
    schema = "key long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for text, at in zip(batch["text"], batch["at"], strict=True):
                words = text.encode().split()  # splits bytes at just the blank characters named above
                kept = words
                if at is not None:
                    cover = np.zeros(len(words) + 1, np.int32)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, np.asarray(at) + WINDOW, -1)
                    kept = [w for w, c in zip(words, np.cumsum(cover), strict=False) if not c]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode()] * keep_text)))
            made = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", *["kept"] * keep_text])
            made.insert(0, "key", batch["key"].array)
            yield made

    made = _with_row(docs).join(repeats, ["key", "row"], "left").select("key", "text", "at").mapInPandas(cut, schema)
    return made.select(F.nullif("key", F.lit(_LOWEST)).alias("doc_id"), *made.columns[1:])


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return remove_repeats(documents(spark, sf_dir), keep_text=False)
