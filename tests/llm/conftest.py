import random

import pytest

LANG = "the of and to in was that with for on his her as at by from they be this have or had not are but one all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


class Corpus:
    """Seeded texts, and documents with the awkward cases that every operator must stand."""

    def __init__(self, spark, seed: int = 1):
        self.spark, self.random = spark, random.Random(seed)

    def text(self, n: int) -> str:
        return " ".join(self.random.choice(LANG) + self.random.choice(["", "", "s", "ed", "ing", "er", "ly"]) for _ in range(n))

    def edited(self, text: str, n: int) -> str:
        words = text.split(" ")
        for _ in range(n):
            words[self.random.randrange(len(words))] = self.random.choice("xyzw") * 6
        return " ".join(words)

    def frame(self, rows, extra: bool = False):
        """(doc_id, text, lang, source, n_chars), with extra also columns whose names operators use themselves."""
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, None, None, None if t is None else len(t)) for i, t in rows]
        df = self.spark.createDataFrame(full, schema)
        if extra:
            from pyspark.sql import functions as F

            for c in ("key", "node", "score", "predicted", "row", "bucket", "length", "piece", "kind", "features", "tail", "unit", "at", "a", "b", "label"):
                df = df.withColumn(c, F.lit(1))
        return df

    def awkward(self):
        """Nulls, empty and blank texts, repeats, one long text, odd characters."""
        long = self.text(30_000)
        same = self.text(80)
        odd = "a\u0000b   café \U0001f600 İstanbul Σς x"
        return [(1, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (4, self.text(60)), (None, same), (None, None), (5, long), (6, odd), (7, same + "\n" + same), (8, "one")]


@pytest.fixture
def corpus(spark):
    return Corpus(spark)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
