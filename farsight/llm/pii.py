"""Personal data by bootstrapped contextual extraction.

Plain patterns find the base entities, which always stay. These are seeds, and so are runs of 32 or more hexadecimal
digits (kind secret). Candidates are all blank-separated tokens without outer marks, after a glued label ("id=") where
there is one; neighbouring tokens of up to six digits each are one candidate. A candidate stands in lexical patterns:

* the word or words before it that end in "=", ":" or "#", or the glued label: for candidates of any form;
* for candidates with a digit: their form with the word before, their form with the word after, and their form alone.

Spark scores the graph of patterns and instances (values) in rounds: a pattern by the mean score of its instances, an
instance by its best reliable pattern, seeds by 1. Reliable patterns mark unseen instances; in the next generation
these are seeds too: they are looked up wherever they stand and raise patterns of their own. Patterns and values are told apart by 64-bit
hashes. What a scan looks for reaches the tasks as a bitmap of fixed size, and is then joined exactly.

Defined results: a null text is the empty text; a null doc_id is kept; repeated rows get equal results; a table
without seeds finds nothing beyond the base; further columns of the input are ignored. No length of token, context or
text is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.llm.shared import documents, sliced, text_or_empty, written
from farsight.llm.textnum import Words, chunks, gathered, mix, ranges

_U = np.uint64
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Begun only where a run of digits begins: from within one, nothing else could match.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NO_DIGIT = re.compile(r"[^0-9]")
#: What surrounds a token: marks, quotes and brackets.
_EDGE = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]{}<>*&%$#|`~", np.uint8))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_LOWER, _UPPER = np.isin(np.arange(256), np.arange(97, 123)), np.isin(np.arange(256), np.arange(65, 91))
_HEX = _DIGIT | np.isin(np.arange(256), np.frombuffer(b"abcdefABCDEF", np.uint8))
_NUMERIC = _DIGIT | np.isin(np.arange(256), np.frombuffer(b"()+-./", np.uint8))
_SEPARATOR = np.isin(np.arange(256), np.frombuffer(b"=:#", np.uint8))
_LOWERED = np.where(_UPPER, np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Bits of the bitmap that says what a scan looks for; other values or patterns that meet it are dropped by the join.
_BITS = 22
_LOWEST = -(1 << 63)

def _luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base entities, by start, then kind as in KINDS."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free, "email"))
        at = text.find("@", max(at + 1, free))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Candidates:
    """Candidates of a few texts: text, place in code points, number of the kind of a seed (0: none), value and patterns (0: none) as hashes."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    patterns: np.ndarray


def _within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each range."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    return sums[end] - sums[start]


def _counted(table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each of a few ranges are in a table."""
    some, at = gathered(data, start, end)
    return _within(table[some], at[:-1], at[1:])


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hashes of the bytes of a few ranges."""
    some, at = gathered(data, start, end)
    return ranges(some.astype(_U), at[:-1], at[1:], base)


def candidates(texts: list[str], base: list[list[tuple[int, int, str]]], every: bool = True) -> Candidates:
    """The candidates of texts with the base entities `base`: every one, or only those that are seeds or stand in a pattern."""
    raw = [t.encode() for t in texts]
    words = Words(raw)
    data = words.data
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    n = len(words.start)
    # the inner part of each token: after a glued label, without outer marks
    plain = np.flatnonzero(~_EDGE[data])
    inner = lambda at, limit: np.minimum(np.append(plain, len(data))[np.searchsorted(plain, at)], limit)
    outer = lambda at, limit: np.maximum(np.append(-1, plain)[np.searchsorted(plain, at)] + 1, limit)
    start, end = words.start, outer(words.end, words.start)
    marks = np.flatnonzero(np.isin(data, (0x3D, 0x3A)))
    glue = np.append(-1, marks)[np.searchsorted(marks, np.maximum(end - 1, 0))]
    glued = (glue > start) & (glue < end - 1)
    label_end = np.where(glued, glue + 1, start)
    start = inner(label_end, end)
    # numbers in groups: neighbouring tokens of few digits are one candidate
    digits = _within(_DIGIT[data], words.start, words.end)
    numeric = (digits > 0) & (digits <= 6)
    few = np.flatnonzero(numeric)
    numeric[few] = _counted(_NUMERIC, data, start[few], end[few]) == end[few] - start[few]
    joined = np.concatenate([[False], numeric[1:] & numeric[:-1] & (words.text[1:] == words.text[:-1]) & ~glued[1:]]) if n else np.zeros(0, bool)
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], n)[: len(first)] - 1
    c_start, c_end, label, has_label = start[first], end[last], label_end[first], glued[first]
    text = words.text[first]
    # tokens that a base entity covers make room for it
    spans = [(i, words.text_at[i] + len(t[:a].encode()), words.text_at[i] + len(t[:b].encode()), 1 + KINDS.index(k)) for i, (t, own) in enumerate(zip(texts, base, strict=True)) for a, b, k in own]
    s_text, s_start, s_end, s_kind = (np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ([],) * 4))
    stays = c_end > c_start
    if spans:
        covered = np.zeros(len(data) + 1, np.int64)
        np.add.at(covered, s_start, 1)
        np.add.at(covered, s_end, -1)
        stays &= _within(np.cumsum(covered)[:-1] > 0, c_start, c_end) == 0
    s_first = np.maximum(np.searchsorted(words.start, s_start, "right") - 1, 0)
    s_last = np.maximum(np.searchsorted(words.start, s_end, "left") - 1, 0)
    c_start, c_end = np.concatenate([c_start[stays], s_start]), np.concatenate([c_end[stays], s_end])
    first, last = np.concatenate([first[stays], s_first]), np.concatenate([last[stays], s_last])
    s_glued = (s_start > words.start[s_first]) & _SEPARATOR[data[np.maximum(s_start - 1, 0)]] if len(s_first) else np.zeros(0, bool)
    label, has_label = np.concatenate([label[stays], s_start]), np.concatenate([has_label[stays], s_glued])
    text, kind = np.concatenate([text[stays], s_text]), np.concatenate([np.zeros(int(stays.sum()), np.int64), s_kind])
    ends_in_separator = _SEPARATOR[data[words.end - 1]] if n else np.zeros(0, bool)
    token = lambda at, own: np.where((at >= 0) & (at < n) & (words.text[np.clip(at, 0, max(n - 1, 0))] == own), at, n)
    before = token(first - 1, text)
    labelled = np.append(ends_in_separator, False)[before]
    n_digits = np.where(kind > 0, 1, np.concatenate([[0], np.cumsum(digits)])[last + 1] - np.concatenate([[0], np.cumsum(digits)])[first]) if n else np.zeros(0, np.int64)
    active = np.flatnonzero(labelled | has_label | (n_digits > 0) | (kind > 0))
    value = None if not every else ranges(data.astype(_U), c_start, c_end, 1)
    out = c_start, c_end, text, kind
    # from here on, those in patterns and seeds only
    c_start, c_end, first, last, text, kind, label, has_label, before, labelled = (x[active] for x in (c_start, c_end, first, last, text, kind, label, has_label, before, labelled))
    size = c_end - c_start
    n_digits = _counted(_DIGIT, data, c_start, c_end)
    secret = np.flatnonzero((kind == 0) & (size >= 32) & (n_digits > 0) & (n_digits < size))
    kind[secret[_counted(_HEX, data, c_start[secret], c_end[secret]) == size[secret]]] = len(KINDS) + 1
    # patterns
    bounds = [np.append(x, 0) for x in (words.start, words.end)]

    def word(at: np.ndarray, none: int = 0) -> np.ndarray:
        """Hashes of lower-case tokens; `none` where there is no token."""
        lower, cut = gathered(data, bounds[0][at], bounds[1][at])
        return np.where(at < n, ranges(_LOWERED[lower].astype(_U), cut[:-1], cut[1:]), _U(none))

    bare = labelled & (_counted(_SEPARATOR, data, bounds[0][before], bounds[1][before]) == bounds[1][before] - bounds[0][before])
    second, after = token(first - 2, text), token(last + 1, text)
    form = mix(
        (_counted(_LOWER | (np.arange(256) >= 128), data, c_start, c_end) > 0).astype(_U) | ((_counted(_UPPER, data, c_start, c_end) > 0).astype(_U) << _U(1))
        | ((n_digits == size).astype(_U) << _U(2)) | (np.minimum(size, 63).astype(_U) << _U(3)) | (np.minimum(n_digits, 63).astype(_U) << _U(9))
    )
    left = mix(word(before) + np.where(bare, mix(word(second)), _U(0)))
    begin = words.start[first] if len(first) else first
    lower, cut = gathered(data, begin, np.maximum(label, begin))
    own_label = ranges(_LOWERED[lower].astype(_U), cut[:-1], cut[1:])
    has_digit = n_digits > 0
    some = [(labelled, left), (has_label, own_label), (has_digit, form + word(before, 1)), (has_digit, form - word(after, 1)), (has_digit, form)]
    patterns = np.stack([np.where(there, mix(h + _U(i + 1)) | _U(1), _U(0)) for i, (there, h) in enumerate(some)], axis=1)
    if every:
        all_patterns = np.zeros((len(value), len(some)), _U)
        all_patterns[active] = patterns
        out[3][active] = kind
        (c_start, c_end, text, kind), patterns = out, all_patterns
    else:
        value = _hashed(data, c_start, c_end, 1)
    return Candidates(text, points[c_start] - points[words.text_at[text]], points[c_end] - points[words.text_at[text]], kind, value, patterns)


_PLACES = "key long, tie long, start int, end int, value long, pattern long, kind int"


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, tie, text): tie tells rows with one doc_id apart."""
    return docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))


def scan_base(keyed: DataFrame) -> DataFrame:
    """(key, tie, base, base_sha256, seeds) of each row; seeds are structs of place, value, pattern and kind, one for each pattern."""
    place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    seed = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("pattern", pa.int64()), ("kind", pa.int32())])
    schema = "key long, tie long, base array<struct<start:int,end:int,kind:string>>, base_sha256 string, seeds array<struct<start:int,end:int,value:long,pattern:long,kind:int>>"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, 1 << 19):
                base = [base_spans(t) for t in texts[a:b]]
                found = candidates(texts[a:b], base, False)
                seeds: list[list[dict]] = [[] for _ in base]
                for i in np.flatnonzero(found.kind):
                    own = dict(start=int(found.start[i]), end=int(found.end[i]), value=int(found.value[i].view(np.int64)), kind=int(found.kind[i]))
                    seeds[found.text[i]] += [own | {"pattern": int(p)} for p in found.patterns[i].view(np.int64) if p]
                    if not found.patterns[i].any():
                        seeds[found.text[i]].append(own | {"pattern": 0})
                listed = [",".join(f"{k}:{x}:{y}" for x, y, k in own) for own in base]
                columns = [
                    batch.column("key").slice(a, b - a), batch.column("tie").slice(a, b - a), pa.array([[dict(start=x, end=y, kind=k) for x, y, k in own] for own in base], pa.list_(place)),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]), pa.array(seeds, pa.list_(seed)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "tie", "base", "base_sha256", "seeds"])

    return keyed.mapInArrow(batches, schema)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash of a column of longs, by its lowest bits: of fixed size, however many there are."""
    (column,) = hashes.columns
    bits = hashes.select(F.expr(f"`{column}` & {(1 << _BITS) - 1}L").alias("bit"))
    words = bits.groupBy(F.expr("bit >> 5").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31L AS int)))").alias("bits")).collect()
    out = np.zeros(1 << (_BITS - 5), np.uint32)
    for r in words:
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def places(keyed: DataFrame, wanted: DataFrame, what: str) -> DataFrame:
    """_PLACES of all candidates whose `what` (value or pattern) stands in `wanted`, a table of that one column."""
    held = keyed.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            texts, keys, ties = batch.column("text").to_pylist(), batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            for a, b in chunks(texts, 1 << 19):
                found = candidates(texts[a:b], [base_spans(t) for t in texts[a:b]], what == "value")
                mask = _U((1 << _BITS) - 1)
                fits = found.patterns != 0
                fits &= held.value[(found.patterns & mask).astype(np.int64)] if what == "pattern" else held.value[(found.value & mask).astype(np.int64)][:, None]
                i, p = np.nonzero(fits)
                at = a + found.text[i]
                columns = [keys[at], ties[at], found.start[i].astype(np.int32), found.end[i].astype(np.int32), found.value[i].view(np.int64), found.patterns[i, p].view(np.int64), found.kind[i].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "tie", "start", "end", "value", "pattern", "kind"])

    return keyed.mapInArrow(batches, _PLACES).join(wanted, what, "left_semi")


def induced(edges: DataFrame, known: DataFrame, support: int) -> DataFrame:
    """(pattern): patterns that at least `support` different known values stand in. edges: (value, pattern); known: (value)."""
    return edges.where("pattern <> 0").join(known, "value", "left_semi").select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")


def scored(edges: DataFrame, seeds: DataFrame, *, rounds: int, least: float, support: int) -> tuple[DataFrame, DataFrame]:
    """Reliable patterns (pattern, kind, confidence) and their instances (value, kind, score); edges: distinct (value, pattern), seeds: (value, kind)."""
    graph = edges.join(seeds, "value", "left").select("pattern", "value", "kind")
    now = written(graph.withColumn("score", F.col("kind").isNotNull().cast("double")), "scores")
    for k in range(rounds):
        patterns = now.groupBy("pattern").agg(
            # one more instance of no score keeps rare patterns down
            (F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("score") >= least).alias("known"), F.max("kind").alias("kind"),
        ).where((F.col("confidence") >= least) & (F.col("known") >= support))
        of = patterns.select("pattern", "confidence", F.coalesce("kind", F.lit(0)).alias("of"))
        best = now.join(of, "pattern").groupBy("value").agg(F.max("confidence").alias("best"), F.max_by("of", F.struct("confidence", "pattern")).alias("of"))
        again = F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
        if k < rounds - 1:
            now = written(now.drop("score").join(best, "value", "left").withColumn("score", again).drop("best", "of"), "scores")
    patterns = written(patterns.select("pattern", F.coalesce("kind", F.lit(0)).alias("kind"), "confidence"), "patterns")
    return patterns, best.select("value", F.col("of").alias("kind"), F.col("best").alias("score"))


def find_personal_data(docs: DataFrame, *, generations: int = 2, rounds: int = 3, least: float = 0.7, support: int = 3) -> DataFrame:
    """(doc_id, base, base_sha256, spans): base entities and all spans of each row, which are also of kind secret or like_<kind>.

    A pattern is reliable from a confidence of `least`, with at least `support` different known instances.
    """
    keyed = _keyed(docs)
    scanned = written(scan_base(keyed), "scanned")
    seen = scanned.select("key", "tie", F.explode("seeds").alias("s")).select("key", "tie", "s.*")
    seeds = written(seen.groupBy("value").agg(F.max("kind").alias("kind")), "seeds")
    edges, patterns, found = seen.select("value", "pattern"), None, None
    for generation in range(generations):
        raised = induced(edges, seeds.select("value"), support)
        raised = written(raised if found is None else raised.join(found.select("pattern").distinct(), "pattern", "left_anti"), "raised")
        if raised.isEmpty():
            break
        more = places(keyed, raised, "pattern")
        found = written(more if found is None else found.unionAll(more), "found")
        patterns, instances = scored(found.select("value", "pattern").distinct(), seeds, rounds=rounds, least=least, support=support)
        new = instances.where(F.col("score") >= least).join(seeds, "value", "left_anti").select("value", "kind")
        if generation == generations - 1 or (new := written(new, "new")).isEmpty():
            break
        edges = written(edges.unionAll(places(keyed, new.select("value"), "value").select("value", "pattern")), "edges")
        seeds = seeds.unionAll(new)
    names = F.array(*map(F.lit, (*KINDS, "secret")))
    spans = "array<struct<start:int,end:int,kind:string>>"
    learned = seen.where(F.col("kind") > len(KINDS)).select("key", "tie", "start", "end", F.lit("secret").alias("kind"))
    if patterns is not None:
        marked = found.where("kind = 0").select("key", "tie", "start", "end", "pattern").join(patterns, "pattern")
        best = marked.groupBy("key", "tie", "start", "end").agg(F.max_by("kind", F.struct("confidence", "pattern")).alias("kind"))
        learned = learned.unionAll(best.select("key", "tie", "start", "end", F.concat(F.lit("like_"), F.coalesce(F.get(names, F.col("kind") - 1), F.lit("known"))).alias("kind")))
    learned = learned.groupBy("key", "tie").agg(F.collect_set(F.struct("start", "end", "kind")).alias("learned"))
    both = F.concat("base", F.coalesce("learned", F.array().cast(spans)))
    rank = lambda kind: F.coalesce(F.nullif(F.array_position(names, kind), F.lit(0)), F.lit(9))
    ranked = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = scanned.drop("seeds").join(learned, ["key", "tie"], "left")
    return rows.select(F.nullif("key", F.lit(_LOWEST)).alias("doc_id"), "base", "base_sha256", F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    found = find_personal_data(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, "base_sha256", listed.alias("spans"))
