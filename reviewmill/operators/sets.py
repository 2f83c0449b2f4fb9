"""Set operations on label and key tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.operators import joins


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_set_wins(key: str, *parts: DataFrame) -> DataFrame:
    """Union with one row per key, taken from the earliest part that has it.

    min combines on the map side: a key repeated in many rows reaches its reducer as one row per task.
    Within a part, the smallest row wins.
    """
    columns = parts[0].columns
    rest = [c for c in columns if c != key]
    tagged = union_all(*(part.select(*columns, F.lit(i).alias("part")) for i, part in enumerate(parts)))
    best = tagged.groupBy(key).agg(
        F.min(F.struct("part", *rest)).alias("row")
    )
    return best.select(key, *(F.col(f"row.{c}").alias(c) for c in rest)).select(columns)


def common_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def keys_without(left: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``left`` whose key is not in ``done``, duplicates kept."""
    return joins.not_done(left, done, *keys)
