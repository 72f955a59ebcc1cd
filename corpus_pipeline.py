"""A training corpus from documents: quality, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents; the last adds `copies`, how often the mix takes a document.

Further columns of documents stay as they are, whatever their names; if one is
called copies, the mix adds `copies_`. A null or empty text is scored by the
quality stage like any other; it is in no class of near duplicates unless equal
texts are, holds no passages and no personal data, and the mix takes it 0 times
more than its source's whole rounds. A null doc_id is in no class and always
stays. Repeated rows (doc_id and text) are one document after the second stage.
Very long texts go through every stage whole. n_chars is the text's length after
the third and fourth stages, and null for a null text. Without documents every
stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sondage.llm import decontam, minhash, mixing, pii, quality
from sondage.llm.common import materialise

#: Documents that score less go.
LEAST_QUALITY = 0.3


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, threshold=LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_length(decontam.decontaminate(docs, items))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets."""
    return _with_length(pii.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often."""
    return mixing.mixture(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs


#: No SQL can express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None
