"""Best-fit packing by large-item matching, over a histogram of lengths.

Pieces above a third of the capacity go at most two to a sequence: greedily, the largest takes the largest that
still fits. Smaller ones then best-fit the gaps, largest first. Equal lengths are interchangeable, so the whole
choice is made on counts by length: at most `capacity` numbers, however large the corpus. Each piece then finds
its place by its rank among the pieces of its length; ranks come from counts by task, never from one sorted group.

Defined results: a null text is the empty text, which is its end token alone; a null doc_id is kept; repeated rows
are packed once each; an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farsight.llm.shared import documents, sliced, small_batches, written
from farsight.llm.textnum import chunks

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Parts that a task's encoder remembers, and the longest of them: some 30 MB in all, at most 70.
_CACHED, _LONGEST = 150_000, 40
#: Characters of text that are words in Python at one time (a single longer text goes alone).
_AT_ONCE = 1 << 20
#: Letters that lower() and the tokenizer treat alike.
_PLAIN_LETTERS = re.compile("[A-Za-z\u00c0-\u012f\u0131-\u017f]+")
#: Blank to Python but not to the tokenizer.
_ODD_BLANKS = "\x1c\x1d\x1e\x1f"
#: What is not to be put in lower case here: letters that lower() and the tokenizer may treat differently, and what could become a special token.
_NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u017f]|<\\|")
#: The marks that end a part, after a letter or digit: the tokenizer cuts there.
_LAST_MARKS = re.compile(r"[!-/:-@[-`{-~](?<=[^\W_].)[!-/:-@[-`{-~]*(?=\s|\Z)")


def tokenizer_path() -> str:
    """The file of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _bytes_shown() -> dict[int, int]:
    """How byte-level tokenizers write bytes: visible Latin-1 characters as they are, the others from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


_BYTES_SHOWN = _bytes_shown()


class _Merges:
    """The merges of a byte-level tokenizer, applied to many words at once: in each round every word joins its first pair of least rank."""

    _TIMES, _BITS = np.uint64(0x9E3779B97F4A7C15), 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is no plain table of merges")
        ids, shown = model["vocab"], [chr(_BYTES_SHOWN.get(b, b)) for b in range(256)]
        #: the first symbol of each byte, within a word and at its end
        self.inner, self.last = (np.array([ids[c + tail] for c in shown], np.int64) for tail in ("", model.get("end_of_word_suffix") or ""))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True))
        keys = left << 32 | right
        self.none = len(pairs)
        self.made = np.append(made, -1)
        # a hash table; a pair whose place is taken goes to the next free one
        self.keys, self.ranks = np.full(1 << self._BITS, -1, np.int64), np.full(1 << self._BITS, self.none, np.int64)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            goes = np.flatnonzero(free)[first]
            self.keys[at[goes]], self.ranks[at[goes]] = keys[todo[goes]], todo[goes]
            stays = np.ones(len(todo), bool)
            stays[goes] = False
            # of those that found a free place, the ones that came too late try again beyond it
            todo, at = todo[stays], (at[stays] + 1) & ((1 << self._BITS) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self._TIMES >> np.uint64(64 - self._BITS)).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._place(keys)
        found, ranks = self.keys[at], self.ranks[at]
        far = np.flatnonzero((found != keys) & (found >= 0))
        while len(far):
            at[far] = (at[far] + 1) & ((1 << self._BITS) - 1)
            found[far], ranks[far] = self.keys[at[far]], self.ranks[at[far]]
            far = far[(found[far] != keys[far]) & (found[far] >= 0)]
        return np.where(found == keys, ranks, self.none)

    def ids(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word: letters only, normalised, not empty."""
        if not words:
            return []
        data = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
        ends = np.flatnonzero(data == 10)
        first = np.concatenate([[0], ends[:-1] + 1])
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        out, size = np.full(len(data), -1, np.int64), ends - first
        # `where` is the place in `out` at which the word of a symbol begins; a word is done when none of its pairs is known
        word, symbols = np.repeat(np.arange(len(words)), size), symbols[data != 10]
        where = first
        pair = np.append(np.where(word[1:] == word[:-1], self._rank(symbols[:-1], symbols[1:]), self.none), self.none)
        while len(symbols):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(pair << 32 | np.arange(len(pair)), start)
            goes = best >> 32 < self.none
            if not goes.all():
                size = np.diff(np.append(start, len(symbols)))
                done = np.repeat(~goes, size)
                out[where[word[done]] + np.flatnonzero(done) - np.repeat(start[~goes], size[~goes])] = symbols[done]
                shift = np.cumsum(done)
                best = best[goes]
                best -= shift[best & 0xFFFFFFFF]
                symbols, word, pair = symbols[~done], word[~done], pair[~done]
                if not len(symbols):
                    break
            at = best & 0xFFFFFFFF
            symbols[at] = self.made[best >> 32]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            # the pairs on both sides of what was joined
            for x in (at, at - 1):
                x = x[(x >= 0) & (x + 1 < len(symbols))]
                pair[x] = np.where(word[x] == word[x + 1], self._rank(symbols[x], symbols[x + 1]), self.none)
            if len(symbols):
                pair[-1] = self.none
        held = out >= 0
        raw, stop = out[held].astype("<u4").tobytes(), (4 * np.cumsum(held)[ends]).tolist()
        return [raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]


class _Encoder:
    """Token ids of texts. This tokenizer joins nothing across blanks, so blank-separated parts are encoded once per batch, frequent ones once per task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.mark = "\x01"
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.merges = _Merges(path)

    def _learn(self, parts: Iterable[str]) -> dict[str, bytes]:
        """The ids of parts. Most are a word, which needs the merges alone: no normalising but lower case, and no cutting."""
        words, whole = [], []
        for part in parts:
            (words if part.isalpha() and (part.isascii() or _PLAIN_LETTERS.fullmatch(part)) else whole).append(part)
        out = dict(zip(words, self.merges.ids([*map(str.lower, words)]), strict=True))
        odd = [p for p in whole if self.mark in p or "<|" in p]  # these may hold the mark's token, so they go one by one
        for part in odd:
            out[part] = self._ids(part)
        whole = [p for p in whole if self.mark not in p and "<|" not in p]
        for i in range(0, len(whole), 5000):
            # many parts as one text, with a mark between them whose one token stands nowhere else
            some = whole[i : i + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.mark} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            raw = ids.tobytes()
            for part, a, b in zip(some, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True):
                out[part] = raw[a:b]
        return out

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _parts(text: str) -> list[str]:
        """What is encoded one by one. Plain text goes in lower case with the last marks of its parts apart, so that a word is one part in all its forms."""
        if any(c in text for c in _ODD_BLANKS):
            return [text]
        if "<|" not in text if text.isascii() else not _NOT_PLAIN.search(text):
            text = _LAST_MARKS.sub(r" \g<0>", text.lower())
        return text.split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, with END."""
        end = np.array([END], "<u4").tobytes()
        for a, b in chunks(texts, _AT_ONCE):
            parts = [self._parts(t) for t in texts[a:b]]
            flat = list(chain.from_iterable(parts))
            codes = list(map(self.known.get, flat))
            missing = [i for i, code in enumerate(codes) if code is None]
            if missing:
                times = Counter([flat[i] for i in missing])
                new = self._learn(times.keys())
                for i in missing:
                    codes[i] = new[flat[i]]
                room = _CACHED - len(self.known)
                if room > 0:  # for what is frequent
                    self.known.update(islice(((p, new[p]) for p, n in times.items() if n > 1 and len(p) <= _LONGEST), room))
            at = 0
            for p in parts:
                yield b"".join(codes[at : at + len(p)]) + end
                at += len(p)


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    """One for each Python worker, whose tasks share what it remembers."""
    return _Encoder(path)


class _Counter:
    """Numbers the pieces of each length in the order in which a task sees them."""

    def __init__(self, capacity: int):
        self.seen = np.zeros(capacity + 1, np.int64)

    def __call__(self, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        _, first, n = np.unique(ordered, return_index=True, return_counts=True)
        within = np.empty(len(lengths), np.int64)
        within[order] = np.arange(len(lengths)) - np.repeat(first, n) + self.seen[ordered]
        self.seen[ordered[first]] += n
        return within


_NUMBERED = "task_ int, within_ long"


def _tokenized(docs: DataFrame, path: str, capacity: int, keep_ids: bool) -> DataFrame:
    """The pieces of tokenize(), with the task that made them and their number there among those of their length."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * keep_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * keep_ids + _NUMBERED

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, task = _encoder(path), _Counter(capacity), TaskContext.get().partitionId()
        for some in sliced(it):
            rows = []
            ids, texts = some.column("doc_id").to_pylist(), [t or "" for t in some.column("text").to_pylist()]
            for doc_id, code in zip(ids, encoder.encode(texts), strict=True):
                for k, start in enumerate(range(0, len(code), 4 * capacity)):
                    part = code[start : start + 4 * capacity]
                    rows.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").tolist()] * keep_ids)))
            columns = [pa.array(c, kind) for c, (_, kind) in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            within = number(columns[3].to_numpy())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), task, np.int32)), pa.array(within)], names=[*(n for n, _ in kinds), "task_", "within_"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(batches, schema)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, *, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens: (doc_id, piece, start, length, ids_crc32), with keep_ids also `ids`."""
    return _tokenized(docs, path, capacity, keep_ids).drop("task_", "within_")


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: rows (length, rank, n, each, sequence, offset).

    A row says: of the pieces of `length`, those with ranks from `rank` on fill `n` sequences numbered from
    `sequence`, `each` of them per sequence, one after the other from `offset`.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left[length] += n
    by_gap: dict[int, list[tuple[tuple, int]]] = {}
    has = np.zeros(capacity + 1, bool)

    def put(content: tuple, n: int, gap: int) -> None:
        by_gap.setdefault(gap, []).append((content, n))
        has[gap] = True

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            fits = np.flatnonzero(left[third + 1 : min(length, capacity - length) + 1])
            other = third + 1 + int(fits[-1]) if len(fits) else 0
            if other == length and left[length] < 2:
                other = third + 1 + int(fits[-2]) if len(fits) > 1 else 0
            if not other:
                put(((), length, 1), int(left[length]), capacity - length)
                left[length] = 0
                continue
            n = int(left[length] // 2 if other == length else min(left[length], left[other]))
            left[length] -= n
            left[other] -= n
            put((((), length, 1), other, 1), n, capacity - length - other)
    for length in range(third, 0, -1):
        todo = int(left[length])
        while todo:
            near = int(np.argmax(has[length:])) + length if has[length:].any() else capacity
            each = near // length
            if has[near]:
                content, n = by_gap[near].pop()
                has[near] = bool(by_gap[near])
            else:
                content, n = (), -(-todo // each)
            full = min(n, todo // each)
            if full:
                put((content, length, each), full, near - each * length)
            todo -= full * each
            n -= full
            if n and todo:  # fewer than `each` are left: they share one more sequence
                put((content, length, todo), 1, near - todo * length)
                todo, n = 0, n - 1
            if n and content:
                put(content, n, near)
    rows, sequence, rank = [], 0, np.zeros(capacity + 1, np.int64)
    for groups in by_gap.values():
        for content, n in groups:
            items = []
            while content:
                content, length, each = content
                items.append((length, each))
            offset = 0
            for length, each in reversed(items):
                rows.append((length, int(rank[length]), n, each, sequence, offset))
                rank[length] += n * each
                offset += each * length
            sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "n", "each", "sequence", "offset"]).astype("int64")


def numbered(pieces: DataFrame, capacity: int) -> DataFrame:
    """`pieces` with the task that reads them and their number there among those of their length."""

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, task = _Counter(capacity), TaskContext.get().partitionId()
        for batch in it:
            yield batch.assign(task_=task, within_=number(batch["length"].to_numpy()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInPandas(counted, f"{columns}, {_NUMBERED}")


def _ranked(table: DataFrame) -> DataFrame:
    """A written table of numbered pieces with `rank`, counted from 0 within each length."""
    counts = table.groupBy("length", "task_").count()
    before = Window.partitionBy("length").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    return table.join(starts, ["length", "task_"]).withColumn("rank", F.col("before_") + F.col("within_")).drop("task_", "within_", "before_")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with a column `length` of 1 to `capacity`) with sequence_id and offset."""
    return _placed(written(numbered(pieces, capacity), "pieces"), capacity)


def _placed(table: DataFrame, capacity: int) -> DataFrame:
    """A written table of numbered pieces with sequence_id and offset. Only counts by length reach the driver."""
    ranked = _ranked(table)
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(counts, capacity).sort_values(["length", "rank"], kind="stable")
    held = table.sparkSession.sparkContext.broadcast({c: slots[c].to_numpy() for c in slots})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = held.value
        span = np.int64(1) << 44  # ranks are below this
        at = np.searchsorted(s["length"] * span + s["rank"], length.to_numpy() * span + rank.to_numpy(), "right") - 1
        beyond = rank.to_numpy() - s["rank"][at]
        return pd.DataFrame({"sequence_id": s["sequence"][at] + beyond // s["each"][at], "offset": s["offset"][at] + beyond % s["each"][at] * length.to_numpy()})

    return ranked.withColumn("place", place("length", "rank")).drop("rank").select("*", "place.*").drop("place")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, *, keep_ids: bool = False) -> DataFrame:
    """Tokenize `docs` (doc_id, text), cut what is longer than `capacity`, and pack the pieces."""
    return _placed(written(_tokenized(docs, path or tokenizer_path(), capacity, keep_ids), "pieces"), capacity)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every piece."""
    return pack_documents(documents(spark, sf_dir))
