"""The corpus pipeline: low quality out, near-duplicates to one, benchmark leaks out, secrets masked, sources mixed.

Each stage takes (spark, docs, sf_dir) with all rows that the one before kept, and returns rows with the columns of
documents; the last adds the number of the copy. Stages are written as Parquet and read again between each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontaminate, mixing, quality_classifier, secrets, simhash
from siftline.llm.common import materialize, table

#: Scores below this are rejected.
QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model, QUALITY)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 of their five-word shingles one row: the smallest doc_id's, if there is one."""
    return simhash.keep_similar(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets replaced by their kind."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: No stage but the last can be expressed in SQL (zstandard, XXH64); tests/llm hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
