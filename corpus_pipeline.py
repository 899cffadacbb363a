"""The corpus pipeline: five stages over ``documents``.

quality rules -> exact dedup -> near dedup (n-gram Jaccard join) -> PII
redaction -> packing. Every stage works on all its predecessor kept; all but
the last return the columns of ``documents``. Between stages the rows are
written as Parquet in the cluster's shared folder and read again, so a lost
executor never repeats an earlier stage. A stage's table goes when the next one is
written; the last of them stays for the lazy result that is read from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pizarra.llm import exact_dedup, ngram_join, packing, pii, quality
from pizarra.session import checkpoint_dir, remove

#: The near-dedup stage takes word shingles of this length and similarity.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_filter(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the one with the largest doc_id."""
    return exact_dedup.exact_dedup_keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return ngram_join.near_dedup_keep(docs, n=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by tags."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their places in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The stages hold a trained classifier and a tokenizer: no SQL for run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
