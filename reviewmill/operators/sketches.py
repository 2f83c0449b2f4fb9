"""Quantile sketches per date that merge for any range of dates, stored beside the features.

A sketch keeps a few kilobytes however many values a date has. Merging reads sketches only, so a percentile over years costs
as many small rows as there are dates, and a load adds or replaces the sketches of its own dates.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """The share of ranks by which a quantile is off at most, with twice the published error at 99 per cent confidence."""
    return 2 * 2.296 / size**0.9021  # fixed values of the sketch


def daily_sketches(rows: DataFrame, column: str, by: str = "date", size: int = SIZE) -> DataFrame:
    """(``by``, n, sketch): one sketch of the non-null values of ``column`` per date, combined before the shuffle."""
    value = F.col(column).cast("double")
    usable = rows.select(by, value.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return usable.groupBy(by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def in_range(sketches: DataFrame, first: datetime.date | None, last: datetime.date | None, by: str = "date") -> DataFrame:
    """The dates from ``first`` to ``last``, both included; none is no limit."""
    if first is not None:
        sketches = sketches.filter(F.col(by) >= F.lit(first))
    return sketches if last is None else sketches.filter(F.col(by) <= F.lit(last))


def merged(sketches: DataFrame) -> DataFrame:
    """One row (n, sketch) for all dates; no row if there are none."""
    whole = sketches.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.filter("n > 0")


def quantiles(sketches: DataFrame, fractions: list[float], first=None, last=None) -> DataFrame:
    """(fraction, value, n): a value of the data whose rank is within ``rank_error`` of each fraction."""
    whole = merged(in_range(sketches, first, last))
    # the function takes constants only
    found = F.array(*(F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias("value")) for f in fractions))
    return whole.select("n", F.explode(found).alias("q")).select("q.fraction", "q.value", "n")


def threshold(sketches: DataFrame, fraction: float = 0.95, first=None, last=None) -> float | None:
    """The score threshold of a range of dates, without reading any score."""
    row = quantiles(sketches, [fraction], first, last).first()
    return row["value"] if row else None


def refresh(spark: SparkSession, path: str, rows: DataFrame, column: str, by: str = "date", size: int = SIZE) -> None:
    """Write the sketches of the dates that ``rows`` has, a folder per date; other dates stay. ``rows`` must hold their dates
    whole."""
    made = daily_sketches(rows, column, by, size).hint("rebalance", by)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
