"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it kept, changed where it redacts; the
last returns the packed pieces. ``run`` chains them, each stage's result written to the shared folder and read
again, so that a lost executor never costs more than the stage at hand.

Of every stage: nulls in any column are borne (a null text is an empty one; a null doc_id is a document like any other); columns
of any further name stay as they came, also where an operator makes one of the same name; repeated rows are each decided on alike; no documents, no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixspark.llm import decontaminate, neardup, packing, quality, secrets
from helixspark.llm.common import scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Without usable labels nothing is rejected."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that with the smallest doc_id) of each class of near-duplicates. Texts without a word all stay."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all, if there is no item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars set anew where there were any."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; an empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The stages learn and hash, which SQL cannot express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
