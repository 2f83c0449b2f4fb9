"""Connected components of links between ids, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.session import forget, new_path, settle_at


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component) for every long id in a link; component is the smallest id that links reach.

    Alternating large-star and small-star steps: every id hands the smallest id it knows of to its larger, then to its
    smaller neighbours, until the links are stars. Each step is settled. The smallest ids are aggregated with partial
    sums and settled before they are joined back, so a hub's links can be split over tasks.
    """
    spark = links.sparkSession
    pairs = links.filter(F.col(left) != F.col(right)).select(
        F.least(left, right).alias("small"), F.greatest(left, right).alias("large")
    )
    old = new_path(spark, "links")
    current = settle_at(pairs.distinct(), old)
    while not _all_stars(current):
        used = [new_path(spark, name) for name in ("lowest", "large-star", "lowest", "small-star")]
        both = current.select(F.col("large").alias("u"), F.col("small").alias("v")).unionByName(
            current.select(F.col("small").alias("u"), F.col("large").alias("v"))
        )
        lowest = settle_at(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), used[0])
        up = both.filter("v > u").join(lowest, "u").select(F.col("low").alias("small"), F.col("v").alias("large"))
        up = settle_at(up.filter("small <> large").distinct(), used[1])
        lowest = settle_at(up.groupBy("large").agg(F.min("small").alias("low")), used[2])
        down = up.join(lowest, "large").filter("small <> low").select(F.col("low").alias("small"), F.col("small").alias("large"))
        down = down.unionByName(lowest.select(F.col("low").alias("small"), "large"))
        current = settle_at(down.distinct(), used[3])
        forget(spark, old, *used[:3])
        old = used[3]
    stars = current.select(F.col("large").alias("id"), F.col("small").alias("component"))
    return stars.unionByName(current.select(F.col("small").alias("id"), F.col("small").alias("component")).distinct())


def _all_stars(pairs: DataFrame) -> bool:
    """Whether every id is either a centre or linked to one centre only."""
    ends = pairs.select(F.col("large").alias("id"), F.lit(1).alias("links"), F.lit(0).alias("centre")).unionByName(
        pairs.select(F.col("small").alias("id"), F.lit(0).alias("links"), F.lit(1).alias("centre"))
    )
    ids = ends.groupBy("id").agg(F.sum("links").alias("links"), F.max("centre").alias("centre"))
    return not ids.agg(F.count_if(F.col("links") + F.col("centre") > 1).alias("n")).first()["n"]
