"""The training-data pipeline: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes all that the one before kept.  All but the last return the
columns of ``documents``; the last returns the ids of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolecall.llm import decontaminate as contamination
from rolecall.llm import neardup, pieces, pii, quality
from rolecall.llm.rows import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the quality network on labelled documents; documents that it rejects go."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: one document of each group stays."""
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced, terms that disclose it are generalised or removed."""
    return pii.sanitised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, with the check that they decode to it."""
    return pieces.encoded(docs)


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("pii_sanitisation", sanitise),
    ("sentencepiece_encoding", encode),
]

#: Learned filters and shortest paths have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet in
    the shared folder and read again.  Those tables go when the session ends.

    A null text is scored, sanitised and encoded as an empty one, is no copy of any
    other row and holds no benchmark passage; rows that repeat a doc_id and a text stay
    or go together; a null doc_id is kept as it is; an empty table gives an empty
    table; other columns pass unchanged under any name, up to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
