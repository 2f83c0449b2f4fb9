"""Folds of documents by a checksum of their id, and bounded samples of rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def sample_ids(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` ids of each label, in the order of a hash: the same ones however the rows are laid out.

    Rows are first thinned by their hash to about twice that many of a label, so a frequent label never meets in one
    task. The counts have one row per label, as the model has.
    """
    ids = rows.select(key, label).filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    share = ids.groupBy(label).agg((F.lit(2.0 * per_label + 100) / F.count("*")).alias("_share"))
    place = F.xxhash64(key)
    near = ids.join(F.broadcast(share), label).filter(place.cast("double") < (F.col("_share") * 2.0 - 1.0) * 2.0**63)
    order = Window.partitionBy(label).orderBy(place, key)
    return near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= per_label).select(key, label)
