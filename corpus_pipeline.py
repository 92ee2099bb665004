"""A corpus pipeline of four operators: rules, classifier, near-duplicates, packing.

Every stage takes empty tables, texts of any length and further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contestry.llm import near_copies, packing, quality, risk_rules
from contestry.llm.common import spool, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns. A null text has no words and so goes; one without an id is judged like any other."""
    return risk_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, keeps, all columns. Null texts count as empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, all columns: the smallest id (null ids last). Empty and null texts are one class."""
    return near_copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence; every row of ``docs`` is packed, repeated ones too. Null texts are the end id alone."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_duplicates", near_duplicates), ("packing", pack)]

#: No SQL: the fitted classifier, hashed shingles and the tokenizer have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
