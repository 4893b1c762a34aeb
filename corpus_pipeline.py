"""A training corpus in five stages, each an operator of ``lodestone.llm`` over all its predecessor kept.

Every stage but the last returns rows of its input with the input's columns, whatever further columns those
have; an empty table stays empty, and repeated rows are judged alike. A null or empty text is dropped by the
quality rules. Where a stage is reached by one all the same, the classifier scores it by its shape, near dedup
keeps it, passage dedup drops it as it has no word, and packing makes the end id of it. Null doc_ids stay: near
dedup compares none of them, and passage dedup takes them as the first documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import neighbours, packing, rules, simhash, suffixes
from lodestone.sources.readers import table
from lodestone.storage import discard, drop_since, materialise, position


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the fences of their language and source go."""
    return rules.filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote down go. Labels belong to the unfiltered documents."""
    return neighbours.filter_documents(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.without_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that also start earlier are cut out."""
    return suffixes.clean_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.definition())


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("passage dedup", passage_dedup),
    ("packing", pack),
]
#: The classifier, the near copies and the suffix order have no SQL; tests/llm/test_pipeline.py holds each stage and
#: run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again as the next one's input.

    A stage's intermediate tables, and its input, are deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        begin, before = position(spark), docs
        docs = materialise(stage(spark, before, sf_dir), name.replace(" ", "-"))
        drop_since(spark, begin, docs)
        discard(before)
    return docs
