"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon is learned from the labelled sample too: words and word beginnings that stand out in toxic texts.
Fitting uses at most `max_rows` labelled rows (a documented bound); every text is scored, over its whole length.

Defined results: a null text is the empty text and gets a score like any other; a null doc_id is kept; repeated
rows get equal scores; without labels of both kinds the score is the share of positive labels (0 without labels).
Further columns of the input are carried along; the outputs replace input columns named score or predicted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.llm.shared import documents, small_batches, text_or_empty, written
from farsight.llm.textnum import chunks

FEATURES = (
    "strong_hits", "strong_density", "strong_terms", "weak_hits", "weak_density", "addressed",
    "capitals", "shouted", "marks", "runs_of_marks", "obfuscated", "hidden_hits", "length",
)

#: Second-person words of the languages in the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
)
NEAR = 5
STARTS = (3, 4, 5, 6)
_TRIM = ".,;:!?\"'()[]{}<>*&%$#~`"
_PLAIN = str.maketrans("013457@$!|", "oieastasil", "*._-")
_MIXED = re.compile(r"[^\W\d_]+[\d@$*!|._-]+[^\W\d_]")
_MARKS = re.compile(r"[!?.,*#&%$]{2,}")
_UPPER = bytes(range(65, 91))
_NO_PUNCTUATION = b"!?*#&%$@"
_CACHED, _LONGEST = 200_000, 40


def terms(word: str) -> list[str]:
    """A word and its beginnings, the latter marked with a trailing hyphen."""
    return [word, *(f"{word[:n]}-" for n in STARTS if len(word) > n)]


class _Marks(dict):
    """What each word of a text says, as bits: tier (2 bits), hidden, shouted, second person, then runs of marks and mixed parts (24 bits each).

    Filled as words turn up; bounded in entries and in their length.
    """

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def tier(self, lower: str) -> int:
        """2 for a strong word, 1 for a weak one."""
        plain = lower.strip(_TRIM)
        return max((self.lexicon.get(t, 0) for t in terms(plain)), default=0) if plain else 0

    def __missing__(self, word: str) -> int:
        lower = word.lower()
        tier = self.tier(lower)
        code = tier | word.isupper() << 3 | (lower.strip(_TRIM) in SECOND_PERSON) << 4
        if not word.isalpha():
            code |= (not tier and self.tier(lower.translate(_PLAIN)) == 2) << 2 | len(_MARKS.findall(word)) << 8 | len(_MIXED.findall(word)) << 32
        if len(word) <= _LONGEST:
            if len(self) >= _CACHED:
                self.clear()
            self[word] = code
        return code


def features_of(texts: list[str], marks: _Marks) -> np.ndarray:
    """The dense features of texts, in the order of FEATURES."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    codes = np.fromiter(map(marks.__getitem__, chain.from_iterable(words)), np.int64, first[-1])
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[first]).astype(float)
    strong = np.flatnonzero(codes & 3 == 2)
    text = np.searchsorted(first, strong, "right") - 1
    you = np.concatenate([[0], np.cumsum(codes >> 4 & 1)])
    near = you[np.minimum(strong + NEAR + 1, first[text + 1])] > you[np.maximum(strong - NEAR, first[text])]
    different: list[set[str]] = [set() for _ in texts]
    for i, t in zip(strong.tolist(), text.tolist(), strict=True):
        different[t].add(words[t][i - int(first[t])].lower())
    raw = [t.encode() for t in texts]
    size = np.maximum([len(r) for r in raw], 1)
    capitals, punctuation = (np.array([len(r) - len(r.translate(None, c)) for r in raw]) / size for c in (_UPPER, _NO_PUNCTUATION))
    hits, weak, some = total(codes & 3 == 2), total(codes & 3 == 1), np.maximum(n, 1)
    return np.stack([
        hits, 100 * hits / some, np.array([len(d) for d in different], float), weak, 100 * weak / some,
        np.bincount(text, near, len(texts)) / np.maximum(hits, 1), capitals, total(codes >> 3 & 1) / some, punctuation,
        total(codes >> 8 & 0xFFFFFF) / some, total(codes >> 32) / some, total(codes >> 2 & 1), n.astype(float),
    ], axis=1)


def with_features(docs: DataFrame, lexicon: dict[str, int], text: str = "text") -> DataFrame:
    """`docs` without its text, with an array column `features`."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marks = _Marks(held.value)
        for texts in batches:
            values = [t or "" for t in texts]
            yield pd.Series([row for a, b in chunks(values) for row in features_of(values[a:b], marks)])

    rest = [c for c in docs.columns if c not in (text, "features")]
    return docs.select(*rest, features(text_or_empty(text)).alias("features"))


def learn_lexicon(sample: DataFrame, positives: int, negatives: int, *, ratio: float = 8.0, size: int = 4000) -> dict[str, int]:
    """Terms that stand out in the toxic texts of `sample` (text, label): 2 where they cover many of these, else 1.

    At most `size` terms, the best covering ones; counts are summed in tasks before the shuffle.
    """

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(batch["text"], batch["label"], strict=True):
                words = {w.strip(_TRIM) for w in t.lower().split()}
                seen[int(y)].update({x for w in words if w for x in terms(w)})
            if every := list(seen[0].keys() | seen[1].keys()):
                yield pd.DataFrame({"term": every, "pos": [seen[1][t] for t in every], "neg": [seen[0][t] for t in every]})

    least = 3 if positives >= 100 else 2
    lift = (F.col("pos") / F.lit(float(positives))) / ((F.col("neg") + F.lit(0.5)) / F.lit(float(negatives)))
    found = (
        sample.select("text", "label").mapInPandas(counted, "term string, pos long, neg long")
        .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((F.col("pos") >= least) & (lift >= ratio))
        .orderBy(F.desc("pos"), "term").limit(size).collect()
    )
    strong = max(4, 0.03 * positives)
    return {r["term"]: 2 if r["pos"] >= strong else 1 for r in found}


@dataclass
class ToxicityModel:
    """A lexicon, trees and a calibration; `constant` is the score where nothing could be fitted."""

    lexicon: dict[str, int]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` without its text, with `score` (0 to 1) and `predicted` (1 from a score of 0.5)."""
        docs = docs.drop("score", "predicted")
        if self.trees is None:
            scored = docs.drop(text).withColumn("score", F.lit(self.constant))
        else:
            keep = [c for c in docs.columns if c != text]
            # the model's own columns get names that no input column has
            inner = with_features(docs.select(F.struct(*keep).alias("row"), text), self.lexicon, text)
            margin = self.trees.transform(inner.withColumn("features", array_to_vector("features")))
            margin = margin.select("row", vector_to_array("rawPrediction")[1].alias("margin"))
            # isotonic steps tie many texts: a hundredth of the trees' own probability orders these
            score = 0.99 * F.col("prediction") + 0.01 / (1 + F.exp(-2 * F.col("margin")))
            scored = self.calibration.transform(margin).select("row.*", score.alias("score"))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))
        return scored.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Fit on docs (doc_id, text) with at most `max_rows` of labels (doc_id, label in {0, 1}), chosen by a hash of doc_id.

    A quarter of these, by another hash, fits the calibration only: neither lexicon nor trees see it, unless it or the
    rest lacks texts of one kind. The chosen labels are broadcast to the scan of docs.
    """
    chosen = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    apart = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0, F.lit(False))
    known = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = written(known.withColumn("apart", apart), "toxic-sample")
    counts = {(r["apart"], r["label"]): r["count"] for r in sample.groupBy("apart", "label").count().collect()}
    positives, negatives = (sum(n for (_, y), n in counts.items() if y == label) for label in (1, 0))
    constant = positives / max(1, positives + negatives)
    if positives < 2 or negatives < 2:
        return ToxicityModel({}, None, None, constant)
    split = len(counts) == 4
    if split:
        positives, negatives = counts[False, 1], counts[False, 0]
    lexicon = learn_lexicon(sample.where(~F.col("apart")) if split else sample, positives, negatives)
    data = written(with_features(sample, lexicon), "toxic-features")
    data = data.withColumn("features", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    own, calibrating = (data.where(~F.col("apart")), data.where("apart")) if split else (data, data)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=1).fit(own)
    margins = model.transform(calibrating).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins)
    return ToxicityModel(lexicon, model, calibration, constant)


def held_out(doc_id: str = "doc_id"):
    """Whether labels of a document are kept from fitting: crc32 of its id as text is divisible by 5 (a null id counts as "")."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit_from(spark, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Fit on the labels of `sf_dir` that are not held out, with the texts of these documents in `docs`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("label"))
    return fit(docs.select("doc_id", "text"), labels)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = documents(spark, sf_dir)
    model = fit_from(spark, docs, sf_dir)
    return model.score(docs.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text")))
