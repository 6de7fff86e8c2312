"""Benchmark decontamination by the q-gram lemma, with banded alignment.

An item of m characters leaks into a document where some passage is within its edit budget of k, 6 % of m (less
for short items, so that the lemma still tells something). Such a passage shares at least m + 1 - q (k + 1) of
the item's q-grams, with diagonals that span at most k. Shared q-grams are counted in bands of 2 (k + 1)
diagonals, each overlapping the next by half; bands with enough of them are aligned, within the band and the text only.
Of an item's q-grams only those that few items have are looked up, where the bound leaves some of them that every leak
shares; an item that shared phrases fill too much for that is looked up by shorter q-grams, whose bound is higher.
Texts are compared in lower case with each run of other characters than letters and digits as one blank.

The benchmark is a stated query set. It is read in blocks of bounded size, each broadcast and compared with every
document; one block is enough for some ten thousand items.

Defined results: null or empty texts, of documents or items, match nothing; an item of under 12 normalised
characters matches only as whole words without any edit; a null doc_id or item_id is kept; repeated rows are
judged one by one; further columns of `documents` are kept by `decontaminate` and ignored by `find_leaks`.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.llm.shared import documents, small_batches
from farsight.llm.textnum import chunks, rolling

_U = np.uint64
Q = 12
BUDGET = 0.06
#: Lengths of q-grams tried for an item, how many rare ones its leaks must then share, and the part of the items
#: (but FEW at least) that makes a q-gram common where more places than that hold it.
LEVELS = ((Q, 1, 50), (8, 2, 50), (6, 4, 50), (5, 6, 50), (Q, 1, 8), (8, 2, 8), (6, 4, 8))
FEW = 8
#: Items without telling q-grams that are looked up together; bands aligned in one go, and cells of them at once.
TOGETHER = 32
PAIRS = 20_000
CELLS = 1 << 16
#: Characters of benchmark text in one broadcast block.
BLOCK = 4_000_000
_BITS = 22
_SPREAD = _U(0x9E3779B97F4A7C15)
_LETTER: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters or digits; those beyond the basic plane count as letters."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalnum() for c in range(1 << 16)]))
    return _LETTER[0][np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, a 0 after each, and where each came from in the texts (a break counts one)."""
    lower = [t.lower() for t in texts]
    lower = [x if len(x) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for x, t in zip(lower, texts, strict=True)]
    codes = np.frombuffer(("\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    # of a run of others the first stays, as a blank; breaks always stay
    keep = letter | (codes == 0) | np.concatenate([[False], letter[:-1]])
    return np.where(letter | (codes == 0), codes, 0x20)[keep], np.flatnonzero(keep)


@dataclass
class Grams:
    """Rare q-grams of some items: their hashes, the places (item, at) of each, and how many an item's leak must share."""

    q: int
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    least: np.ndarray


@dataclass
class Index:
    """A block of items. `same` has, for the first item of each normalised text, all items of that text."""

    ids: list
    texts: list[np.ndarray]
    budget: np.ndarray
    levels: list[Grams]
    short: dict[int, dict[int, list[int]]]
    same: dict[int, list[int]]


def _places(codes: list[np.ndarray], items: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, item and place of all q-grams of some items."""
    size = np.array([len(codes[i]) - q + 1 for i in items])
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.concatenate([rolling(codes[i].astype(_U), q) for i in items]), np.repeat(items, size), at


def _grams(q: int, hashes: np.ndarray, item: np.ndarray, at: np.ndarray, least: np.ndarray) -> Grams:
    order = np.argsort(hashes, kind="stable")
    unique, first = np.unique(hashes[order], return_index=True)
    return Grams(q, unique, np.append(first, len(hashes)), item[order], at[order], least)


def _levels(codes: list[np.ndarray], budget: np.ndarray, items: np.ndarray) -> list[Grams]:
    """Each item in one level: the longest q for which its rare q-grams alone must show in any leak.

    Of the m + 1 - q (k + 1) q-grams that a leak shares, at most those that many items have are no evidence; the others
    must be met, so common q-grams need not be looked up at all. Items for which no q leaves any (those that shared
    phrases fill nearly whole) are looked up by all their q-grams, few items at a time.
    """
    size, out = np.array([len(c) for c in codes]), []
    block = len(items)
    for q, telling, part in LEVELS:
        if not len(items):
            return out
        most = max(FEW, block // part)
        hashes, item, at = _places(codes, items, q)
        _, of, n = np.unique(hashes, return_inverse=True, return_counts=True)
        common = n[of] > most
        least = size + 1 - q * (budget + 1) - np.bincount(item[common], minlength=len(codes))
        placed = least >= telling
        if placed[items].any():
            use = ~common & placed[item]
            out.append(_grams(q, hashes[use], item[use], at[use], least))
        items = items[~placed[items]]
    for a in range(0, len(items), TOGETHER):
        out.append(_grams(Q, *_places(codes, items[a : a + TOGETHER], Q), size + 1 - Q * (budget + 1)))
    return out


def build_index(ids: list, texts: list[str], q: int = Q, share: float = BUDGET) -> Index:
    """Index items; `short` has those below q characters by length and hash."""
    codes, same, short = [], {}, {}
    for t in texts:
        c = normalised([t])[0][:-1]
        codes.append(c[1 if len(c) and c[0] == 0x20 else 0 : -1 if len(c) and c[-1] == 0x20 else None])
    by_text: dict[bytes, int] = {}
    for i, c in enumerate(codes):
        if len(c):
            same.setdefault(by_text.setdefault(c.tobytes(), i), []).append(i)
    size = np.array([len(c) for c in codes])
    budget = np.maximum(np.minimum((share * size).astype(int), size // q - 1), 0)
    for i in same:
        if size[i] < q:
            short.setdefault(len(codes[i]), {}).setdefault(int(rolling(codes[i].astype(_U), len(codes[i]))[0]), []).append(i)
    return Index(ids, codes, budget, _levels(codes, budget, np.array([i for i in same if size[i] >= q], np.int64)), short, same)


def _strip(text: np.ndarray, low: int, size: int) -> np.ndarray:
    """text[low : low + size], with 0, which matches no item, where there is no text."""
    out = np.zeros(size, np.uint32)
    a, b = max(0, low), min(len(text), low + size)
    if b > a:
        out[a - low : b - low] = text[a:b]
    return out


def _aligned(items: list[np.ndarray], strips: list[np.ndarray]) -> list[np.ndarray]:
    """Least edits of each item against passages of its strip, by where they end: entry j is the end at len(item) + j.

    A strip is as much longer than its item as the band has diagonals; a passage may start on any of them for nothing.
    Many are aligned at once, those of like width together, at most CELLS cells of the bands (and one band at least).
    """
    size = np.array([len(x) for x in items])
    width = np.array([len(x) for x in strips]) - size
    order = np.lexsort((size, width))
    out: list[np.ndarray] = [None] * len(items)
    start = 0
    while start < len(order):
        widest = np.maximum.accumulate(width[order[start : start + 4096]])
        n = max(1, int(np.searchsorted(np.arange(1, len(widest) + 1) * widest, CELLS, "right")))
        some = order[start : start + n]
        start += n
        some = some[np.argsort(-size[some], kind="stable")]
        m, w = size[some], width[some]
        longest, wide = int(m[0]), int(w.max())
        # one column per pair, so that each step works on whole rows
        item, strip = np.zeros((longest, n), np.uint32), np.zeros((longest + wide, n), np.uint32)
        for j, x in enumerate(some):
            item[: m[j], j] = items[x]
            strip[: m[j] + w[j], j] = strips[x]
        far = np.int32(longest + wide)
        wall = np.where(np.arange(wide)[:, None] < w, 0, far).astype(np.int32)
        ramp = np.arange(wide, dtype=np.int32)[:, None]
        cost = wall.copy()
        active = np.searchsorted(-m, -np.arange(longest), "left")
        for i in range(longest):
            now = cost[:, : active[i]]
            step = now + (strip[i : i + wide, : active[i]] != item[i, : active[i]])
            np.minimum(step[:-1], now[1:] + 1, out=step[:-1])
            step -= ramp
            np.minimum.accumulate(step, axis=0, out=step)
            step += ramp
            np.maximum(step, wall[:, : active[i]], out=now)
        for j, x in enumerate(some):
            out[x] = cost[: w[j], j].copy()
    return out


def _best_apart(cost: np.ndarray, place: np.ndarray, most: int, apart: int) -> list[int]:
    """Entries of at most `most`, the best first (ties: the first place), each at least `apart` places from those before it."""
    near = np.flatnonzero(cost <= most)
    out: list[int] = []
    taken: list[int] = []
    for i in near[np.lexsort((place[near], cost[near]))]:
        p = int(place[i])
        at = bisect.bisect(taken, p)
        if (at == 0 or p - taken[at - 1] >= apart) and (at == len(taken) or taken[at] - p >= apart):
            taken.insert(at, p)
            out.append(int(i))
    return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sum of their counts."""
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(of, np.concatenate(counts)).astype(np.int64)


def _dense_bands(index: Index, grams: Grams, hits: np.ndarray, gram: np.ndarray, text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, band), in order, of the bands with enough q-grams of an item for its budget.

    hits: places of q-grams number `gram` in texts `text`. At most about `limit` pairs of a hit and an item's place
    are expanded at a time. A level's q-gram has few places or its items are few, so the bands kept are bounded too: by
    the characters of the texts times the bound on places, and times `TOGETHER` where all q-grams are looked up.
    """
    n = grams.first[gram + 1] - grams.first[gram]
    piece = (np.cumsum(n) - 1) // limit
    # one number for text, item and band, which may be below 0 by the places of the longest item
    span, before = np.int64(len(index.texts)), np.int64(grams.at.max() + 2)
    bands = np.int64(before + hits[-1] + 1)
    keys, counts, held = [], [], 0
    for p in np.unique(piece):
        some = np.flatnonzero(piece == p)
        m = n[some]
        entry = np.repeat(grams.first[gram[some]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        item, diagonal = grams.item[entry], np.repeat(hits[some], m) - grams.at[entry]
        band = np.floor_divide(diagonal, index.budget[item] + 1)
        one = (np.repeat(text[some], m) * span + item) * bands + band + before
        key, count = np.unique(np.concatenate([one, one - 1]), return_counts=True)
        keys.append(key)
        counts.append(count)
        held += len(count)
        if held > limit and len(keys) > 1:
            keys, counts = ([x] for x in _merged(keys, counts))
            held = 0
    key, count = _merged(keys, counts)
    who, band = key // bands, key % bands - before
    enough = count >= grams.least[who % span]
    return who[enough] // span, who[enough] % span, band[enough]


def _hits(grams: Grams, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values hold q-grams of a level, and which."""
    hashes = rolling(values, grams.q)
    seen = np.zeros(1 << _BITS, bool)
    seen[(grams.hashes * _SPREAD) >> _U(64 - _BITS)] = True
    hits = np.flatnonzero(seen[(hashes * _SPREAD) >> _U(64 - _BITS)])
    gram = np.minimum(np.searchsorted(grams.hashes, hashes[hits]), len(grams.hashes) - 1)
    true = grams.hashes[gram] == hashes[hits]
    return hits[true], gram[true]


def _passages(index: Index, codes: np.ndarray, breaks: np.ndarray, text: np.ndarray, item: np.ndarray, band: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the passages in dense bands, as places in the codes."""
    # neighbouring bands of one item in one text are aligned together
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    k = index.budget[item[first]]
    left = np.where(text[first] > 0, breaks[text[first] - 1] + 1, 0)
    right = breaks[text[first]]
    low, high = band[first] * (k + 1) - k - left, (band[last] + 2) * (k + 1) + k - left
    patterns = [index.texts[i] for i in item[first]]
    cost = _aligned(patterns, [_strip(codes[a:b], int(lo), int(hi - lo) + 1 + len(p)) for a, b, lo, hi, p in zip(left, right, low, high, patterns, strict=True)])
    # what is alike on the bands of several runs is judged once
    group = np.flatnonzero(np.concatenate([[True], (text[first][1:] != text[first][:-1]) | (item[first][1:] != item[first][:-1])]))
    found = []
    for a, b in zip(group, np.append(group[1:], len(first)), strict=True):
        length = len(patterns[a])
        ends = np.concatenate([np.minimum(low[r] + length + np.arange(len(cost[r])), right[r] - left[r]) for r in range(a, b)])
        edits = np.concatenate(cost[a:b])
        for best in _best_apart(edits, ends, int(k[a]), max(1, length - int(k[a]))):
            found.append((a, int(ends[best]), int(edits[best])))
    # the same from the end backwards gives the start
    back = []
    for a, end, _ in found:
        own, length = codes[left[a] : right[a]], len(patterns[a])
        back.append(_strip(own[max(0, end - length - int(k[a])) : end][::-1], 0, length + int(k[a]) + 1))
    for (a, end, edits), ways in zip(found, _aligned([patterns[a][::-1] for a, _, _ in found], back), strict=True):
        length = len(patterns[a]) + (int(np.argmin(ways)) if ways.min() == edits else 0)
        yield int(item[first[a]]), int(left[a]) + max(0, end - length), int(left[a]) + end, edits


def matches(index: Index, texts: list[str], limit: int = 1 << 21) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of leaks; starts and ends are code points of the text.

    A text holds an item as often as passages apart from each other meet its budget. Each text is judged by itself.
    """
    codes, origin = normalised(texts)
    values = codes.astype(_U)
    breaks = np.flatnonzero(codes == 0)
    out = []
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])

    def found(item: int, start: int, end: int, edits: int) -> None:
        at = int(np.searchsorted(begin, origin[start], "right")) - 1
        out.extend((at, i, int(origin[start] - begin[at]), int(origin[end - 1] - begin[at]) + 1, edits) for i in index.same[item])

    for grams in index.levels:
        hits, gram = _hits(grams, values)
        if len(hits):
            text, item, band = _dense_bands(index, grams, hits, gram, np.searchsorted(breaks, hits), limit)
            # whole (text, item) groups, about as many bands at a time as fill a bounded number of strips
            group = np.cumsum(np.concatenate([[0], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])[: len(item)])
            cut = np.flatnonzero(np.diff(np.searchsorted(group, group) // PAIRS, prepend=-1))
            for a, b in itertools.pairwise([*cut, len(item)]):
                for row in _passages(index, codes, breaks, text[a:b], item[a:b], band[a:b]):
                    found(*row)
    for length, by_hash in index.short.items():
        hashes = rolling(values, length)
        for at in np.flatnonzero(np.isin(hashes, np.array(list(by_hash), _U))):
            end = int(at) + length
            if (at == 0 or codes[at - 1] in (0, 0x20)) and codes[end] in (0, 0x20):
                for i in by_hash[int(hashes[at])]:
                    if (codes[at:end] == index.texts[i]).all():
                        found(i, int(at), end, 0)
    return out


def _blocks(items: DataFrame, block: int) -> Iterator[Index]:
    """Indexes of blocks of the items, each of about `block` characters at most."""
    items = items.select("item_id", "text").where("length(text) > 0").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // block)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield build_index([r["item_id"] for r in rows], [r["text"] for r in rows])


def find_leaks(docs: DataFrame, items: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every leak of items (item_id, text) into docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext

    def finder(held):
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in it:
                texts = [t or "" for t in batch["text"]]
                for a, b in chunks(texts, 1 << 19):
                    rows = matches(held.value, texts[a:b])
                    at = [a + r[0] for r in rows]
                    out = batch[["doc_id", "unnamed"]].iloc[at].reset_index(drop=True)
                    out["item_id"] = pd.array([held.value.ids[r[1]] for r in rows], "Int64")
                    for k, c in enumerate(("start", "end", "edits"), 2):
                        out[c] = np.array([r[k] for r in rows], np.int64)
                    yield out

        return batches

    schema = "doc_id long, unnamed boolean, item_id long, start long, end long, edits long"
    # a null doc_id goes along as a flag, as numbers with nulls would turn to floats
    docs = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), "text")
    found = [docs.mapInPandas(finder(context.broadcast(i)), schema) for i in _blocks(items, block)]
    rows = reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)
    return rows.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "item_id", "start", "end", "edits")


def decontaminate(docs: DataFrame, items: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The rows of docs (text, ...) that no item leaks into."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext

    def judge(held):
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            values = [t or "" for t in texts]
            bad = {a + r[0] for a, b in chunks(values, 1 << 19) for r in matches(held.value, values[a:b])}
            return pd.Series([i not in bad for i in range(len(values))])

        return clean

    for index in _blocks(items, block):
        docs = docs.where(judge(context.broadcast(index))("text"))
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
