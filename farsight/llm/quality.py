"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade > j) = sigmoid(w . x - t_j): one set of weights on hashed text features for all grades, and ordered
thresholds t. A text gets its expected grade and the tail probability of reaching a chosen grade, for selection.
Features are hashed words, hashed triples of character classes, and the shares of repeated and of distinct
words; each enters as the root of its share, so that long texts are not favoured.

Fitting uses at most `max_rows` rated rows (a documented bound); every text is scored, over its whole length.

Defined results: a null text is the empty text and gets a score like any other; a null doc_id is kept; repeated
rows get equal scores; grades without any rated row get no threshold; with one grade only, every text has it, and
without ratings the expected grade is 0. Further columns of the input are carried along; the outputs replace
input columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farsight.llm.shared import documents, text_or_empty, written
from farsight.llm.textnum import SPACES_AND_MARKS, Words, chunks, mix

_U = np.uint64
BITS = 14


def _classes() -> np.ndarray:
    """Byte to one of 32 classes: lower case, upper case, digit, blank, other bytes of a letter, and marks by themselves."""
    out = np.empty(256, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 4 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b <= 32 else 5 + b % 27
    return out


_CLASS = _classes()


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of texts: text, bucket, value."""
    size = 1 << bits
    words = Words([t.lower().encode() for t in texts], SPACES_AND_MARKS)
    raw = Words([t.encode() for t in texts])  # for its bytes and where texts begin
    kind = _CLASS[raw.data]
    three = (kind[:-2] * 1024 + kind[1:-1] * 32 + kind[2:]).astype(_U)
    of = np.repeat(np.arange(len(texts)), np.diff(raw.text_at))[: len(three)]
    columns, values = [], []
    for text, hashes, salt in ((words.text, words.hash, 1), (of, three, 2)):
        bucket = (mix(hashes + _U(salt << 40)) >> _U(64 - bits)).astype(np.int64)
        keys, counts = np.unique(text * size + bucket, return_counts=True)
        total = np.maximum(np.bincount(text, minlength=len(texts)), 1)
        columns.append(keys)
        values.append(np.sqrt(counts / total[keys >> bits]))
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1]))
    repeated = np.bincount(words.text[again], minlength=len(texts))
    distinct = np.bincount((np.unique(np.stack([words.text.astype(_U), words.hash]), axis=1)[0]).astype(np.int64) if len(words.hash) else [], minlength=len(texts))
    rows = np.arange(len(texts)) * size
    for share, bucket in ((repeated, 0), (distinct, 1)):
        columns.append(rows + bucket)
        values.append(np.sqrt(share / np.maximum(words.count, 1)))
    keys = np.concatenate(columns)
    return keys >> bits, keys & (size - 1), np.concatenate(values)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights by bucket, thresholds between the grades that occur, and these grades in order."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray
    bits: int = BITS

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= g) for each text and each grade but the lowest."""
        text, bucket, value = features(texts, self.bits)
        line = np.bincount(text, value * self.weights[bucket], len(texts))
        return _sigmoid(line[:, None] - self.thresholds)

    def score(self, docs: DataFrame, reach: int = 1, text: str = "text") -> DataFrame:
        """`docs` without its text, with expected_grade, tail (the probability of a grade of at least `reach`) and selected."""
        held = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("expected_grade double, tail double")
        def scored(texts: pd.Series) -> pd.DataFrame:
            model = held.value
            steps, above = np.diff(model.grades), np.flatnonzero(model.grades[1:] >= reach)
            out = np.empty((len(texts), 2))
            values = texts.tolist()
            for a, b in chunks(values, 1 << 20):
                tails = model.tails(values[a:b])
                out[a:b, 0] = model.grades[0] + tails @ steps
                out[a:b, 1] = 1.0 if model.grades[0] >= reach else tails[:, above[0]] if len(above) else 0.0
            return pd.DataFrame(out, columns=["expected_grade", "tail"])

        rest = [c for c in docs.columns if c not in (text, "expected_grade", "tail", "selected")]
        return docs.select(*rest, scored(text_or_empty(text)).alias("scored_")).select(*rest, "scored_.*", (F.col("scored_.tail") >= 0.5).alias("selected"))


def fit_ordinal(texts: list[str], grades: list[int], bits: int = BITS, *, steps: int = 250, rate: float = 0.1, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with weight decay, by Adam over all rows."""
    levels, y = np.unique(np.asarray(grades, np.int64), return_inverse=True)
    size, n, k = 1 << bits, len(texts), max(len(levels) - 1, 0)
    if k == 0:
        return OrdinalModel(np.zeros(size), np.zeros(0), levels if len(levels) else np.zeros(1, np.int64), bits)
    parts = [(a, features(texts[a:b], bits)) for a, b in chunks(texts, 1 << 20)]
    row = np.concatenate([t + a for a, (t, _, _) in parts])
    bucket, value = (np.concatenate([p[1][i] for p in parts]) for i in (1, 2))
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n
    start = np.log(share / (1 - share))
    # thresholds stay in order as a first one and logarithms of gaps
    p = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    index = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = p[:size], np.exp(p[size + 1 :])
        t = p[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        line = np.bincount(row, value * w[bucket], n)
        edges = np.concatenate([np.full((n, 1), -40.0), np.clip(t - line[:, None], -39, 39), np.full((n, 1), 40.0)], axis=1)
        up, down = _sigmoid(edges[index, y + 1]), _sigmoid(edges[index, y])
        chance = np.maximum(up - down, 1e-12)
        by_line = 1 - up - down
        by_t = np.zeros((n, k + 2))
        by_t[index, y + 1] -= up * (1 - up) / chance
        by_t[index, y] += down * (1 - down) / chance
        by_t = by_t[:, 1:-1].sum(axis=0)
        suffix = np.cumsum(by_t[::-1])[::-1]
        gradient = np.concatenate([np.bincount(bucket, value * by_line[row], size) / n + decay * w, [suffix[0] / n], suffix[1:] * gaps / n])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        p = p - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(p[:size], p[size] + np.concatenate([[0.0], np.cumsum(np.exp(p[size + 1 :]))]), levels, bits)


def fit(docs: DataFrame, ratings: DataFrame, *, max_rows: int = 6000, **options) -> OrdinalModel:
    """Fit on docs (doc_id, text) with at most `max_rows` of ratings (doc_id, grade), chosen by a hash of doc_id."""
    chosen = ratings.where("grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rows)
    rows = written(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id"), "rated").orderBy("doc_id", "grade").collect()
    return fit_ordinal([r["text"] for r in rows], [r["grade"] for r in rows], **options)


def graded() -> Column:
    """A grade from the labels: 0 for low quality, 1 for good but toxic, 2 for good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def op1_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """(doc_id, expected_grade, tail, selected) for every document, from the ratings whose crc32 of doc_id is not divisible by 5."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return fit(docs, ratings.select("doc_id", graded().alias("grade"))).score(docs)
