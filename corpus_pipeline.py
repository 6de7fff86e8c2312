"""A training corpus from raw documents: toxicity, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.llm import decontamination, line_dedup, minhash_dedup, packing, toxicity
from farsight.llm.shared import documents, written

#: The columns that each stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; fitted on the labels that are not held out."""
    model = toxicity.fit_from(spark, docs, sf_dir)
    # the text goes along under another name: scoring takes the column `text`
    scored = model.score(docs.select(*COLUMNS).withColumn("kept_text_", F.col("text")))
    return scored.where("predicted = 0").withColumnRenamed("kept_text_", "text").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that near-copies of earlier lines make superfluous."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    text = F.col("text")
    return kept.select("row.doc_id", text, "row.lang", "row.source", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash_dedup.deduplicate(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has no trees, signatures or tokenizer; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table, each written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
