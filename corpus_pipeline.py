"""The corpus pipeline: language, quality, exact copies, near copies, packing. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewmill.llm import exact_dedup, language, near_dedup, quality, registry
from reviewmill.session import forget, new_path, scratch, settle_at


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language cannot be determined."""
    return language.keep_identified(docs, registry.language_trees(spark, sf_dir))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the quality classifier rejects."""
    return quality.keep_good(docs, registry.quality_weights(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of equal texts."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near duplicates."""
    return near_dedup.without_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return registry.best_fit_packing(docs)


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_good_quality),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("packing", pack),
]
ORACLE_SQL = None  # learned models and tokens: tests compare the pipeline with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is settled and read again, and goes once the next one is there. What a stage
    settles on its way goes with the stage, so the last result is all that stays."""
    docs, before = registry.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch(spark):
            docs = settle_at(stage(spark, docs, sf_dir), path)
        if before:
            forget(spark, before)
        before = path
    return docs
