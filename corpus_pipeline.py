"""The corpus pipeline: documents through toxicity, two kinds of duplicates, mixing and packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from likeness.llm.common import read, stored
from likeness.llm.exact_dedup import drop_copies
from likeness.llm.mixing import repeated
from likeness.llm.packing import pack_documents
from likeness.llm.queries import VOCABULARY
from likeness.llm.simhash import drop_near_duplicates
from likeness.llm.toxicity import drop_toxic
from likeness.plans.materialise import drop_intermediates, forget_shuffles, scoped

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(name: str, stage: Stage) -> Stage:
    """``stage`` with its intermediates in a part of their own.

    When a stage begins, its predecessor's rows have been written and are read again, so whatever
    the other stages stored is deleted first, and their shuffles are forgotten.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for other, _ in STAGES:
            drop_intermediates(spark, f"pipeline/{other.replace(' ', '_')}")
        forget_shuffles(spark)
        with scoped(f"pipeline/{name.replace(' ', '_')}"):
            return stage(spark, docs, sf_dir)

    return run_stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarity, the one with the smallest id.

    SimHash fingerprints and MinHash bands propose the pairs; the whole shingle sets decide.
    """
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return pack_documents(docs, VOCABULARY)


STAGES = [
    (name, tidy(name, stage))
    for name, stage in (
        ("toxicity", toxicity_stage),
        ("exact dedup", exact_stage),
        ("near dedup", near_stage),
        ("mixing", mixing_stage),
        ("packing", packing_stage),
    )
]

# Classifiers, connected components and token ids are beyond SQL: tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
