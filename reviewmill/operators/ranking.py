"""First reviews per product and full newest-first positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.session import settle


SLICES = 32


def top_per_group(df: DataFrame, n: int, keys: list[str], order: list[Column], position: str = "position") -> DataFrame:
    """The first ``n`` rows per key with their position.

    Below Spark's threshold for ``n`` the limit on row_number keeps at most ``n`` rows per key and map task before the
    shuffle (WindowGroupLimit), so a hot key stays small. From there on rows are first cut to ``n`` in each of ``SLICES``
    slices of a key, which spreads a hot key, and its last window holds at most ``SLICES * n`` rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if n < int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*(F.expr(f"`{c}`") for c in _hashable(df))), F.lit(SLICES)))
    cut = sliced.withColumn(position, F.row_number().over(within)).filter(F.col(position) <= n).drop("_slice", position)
    return cut.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)


def _hashable(df: DataFrame) -> list[str]:
    """Narrow columns that tell rows of a key apart: numbers and times, or all columns if there is none."""
    narrow = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.TimestampType, T.DateType))]
    return narrow or df.columns


def most_helpful(reviews: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most helpful reviews of every product, ties by id."""
    return top_per_group(
        reviews.filter(F.col("asin").isNotNull()), n, ["asin"], [F.desc_nulls_last("helpful_votes"), F.asc("id")]
    )


def newest_first(reviews: DataFrame) -> DataFrame:
    """(asin, id, position): position 1 is the newest review of the asin; null timestamps last, ties by id.

    A product may hold a large part of all reviews, so no task may hold one product. The keys are range-partitioned
    by (asin, time), which splits a hot product over many tasks, and settled. Then each (asin, slice) is numbered
    alone, and the rows of the asin in earlier slices are added. An asin has one summary row per slice it spans.
    """
    order = [F.desc_nulls_last("timestamp"), F.asc("id")]
    keys = reviews.filter(F.col("asin").isNotNull()).select("asin", "timestamp", "id")
    slices = settle(
        keys.repartitionByRange(F.asc("asin"), *order).withColumn("slice", F.spark_partition_id()), "newest-first"
    )
    sizes = slices.groupBy("asin", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("asin").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("asin", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("asin", "slice").orderBy(*order))
    numbered = slices.withColumn("local", local).join(starts, ["asin", "slice"])
    return numbered.select("asin", "id", (F.col("start") + F.col("local")).alias("position"))
