"""Feature drift between an early and a late window of dates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.session import settle

SPLIT_SHARE = 0.7
DRIFT_LIMIT = 0.1
DATASET_LIMIT = 0.5
MIN_DEVIATION = 0.001
METHOD = "Wasserstein distance (normed)"


def split_date(features: DataFrame, share: float = SPLIT_SHARE) -> datetime.date | None:
    """The first date of the current window: position int(share * n) of the sorted distinct dates.

    One row per calendar date reaches the driver.
    """
    dates = [row["date"] for row in features.select("date").distinct().orderBy("date").collect()]
    return dates[int(len(dates) * share)] if dates else None


def with_window(features: DataFrame, first_current: datetime.date | None) -> DataFrame:
    return features.withColumn(
        "window", F.when(F.col("date") < F.lit(first_current), "reference").otherwise("current")
    )


def column_drift(windowed: DataFrame, columns: list[str] = vocab.FEATURES, limit: float = DRIFT_LIMIT) -> DataFrame:
    """Wasserstein distance between the two windows per column, over the reference deviation."""
    is_reference = F.col("window") == "reference"
    row = windowed.agg(*(F.stddev_pop(F.when(is_reference, F.col(c))).alias(c) for c in columns)).first()
    deviation = chain(columns, {c: row[c] or 0.0 for c in columns})
    gaps = share_gaps(value_counts(windowed, columns))
    distance = gaps.groupBy("name").agg(F.coalesce(F.sum(F.col("gap") * F.col("step")), F.lit(0.0)).alias("distance"))
    score = F.col("distance") / F.greatest(deviation, F.lit(MIN_DEVIATION))
    return distance.select(
        F.col("name").alias("column_name"), score.alias("drift_score"), (score >= limit).alias("drift_detected"),
        F.lit(METHOD).alias("stattest"),
    )


def chain(columns: list[str], values: dict[str, float]) -> Column:
    """The value of the column that the row names."""
    found = F.when(F.lit(False), F.lit(None).cast("double"))
    for c in columns:
        found = found.when(F.col("name") == c, F.lit(float(values[c])))
    return found


def value_counts(windowed: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """(name, value, r, c): how often each value occurs in the reference and the current window, nulls left out."""
    is_reference = F.col("window") == "reference"
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {kind})" for c in columns)
    stacked = windowed.selectExpr("window", f"stack({len(columns)}, {pairs}) AS (name, value)").filter("value IS NOT NULL")
    return stacked.groupBy("name", "value").agg(F.count_if(is_reference).alias("r"), F.count_if(~is_reference).alias("c"))


def share_gaps(counts: DataFrame) -> DataFrame:
    """(name, value, gap, step): by how much the shares of values up to this one differ, and the distance to the next value.

    The running shares need an order over all values of a column, so the counts are range-partitioned by (name, value), which
    no outlier and no frequent value can unbalance, and settled. The totals of the parts, one row per column and part, give
    every part its starting share.
    """
    cells = settle(counts.repartitionByRange("name", "value").withColumn("cell", F.spark_partition_id()), "drift")
    totals = cells.groupBy("name", "cell").agg(
        F.sum("r").alias("cell_r"), F.sum("c").alias("cell_c"), F.min("value").alias("first_value")
    )
    along, every = Window.partitionBy("name").orderBy("cell"), Window.partitionBy("name")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "name",
        "cell",
        F.coalesce(F.sum("cell_r").over(before), F.lit(0)).alias("start_r"),
        F.coalesce(F.sum("cell_c").over(before), F.lit(0)).alias("start_c"),
        F.sum("cell_r").over(every).alias("all_r"),
        F.sum("cell_c").over(every).alias("all_c"),
        F.lead("first_value").over(along).alias("next_cell_value"),
    )
    inside = Window.partitionBy("name", "cell").orderBy("value")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        cells.withColumn("sum_r", F.sum("r").over(running))
        .withColumn("sum_c", F.sum("c").over(running))
        .withColumn("next_value", F.lead("value").over(inside))
        .join(starts, ["name", "cell"])
    )
    share = lambda side: (F.col(f"start_{side}") + F.col(f"sum_{side}")) / F.nullif(F.col(f"all_{side}"), F.lit(0))
    step = F.coalesce("next_value", "next_cell_value") - F.col("value")
    return placed.select("name", "value", F.abs(share("r") - share("c")).alias("gap"), step.alias("step"))


def drift_summary(columns: DataFrame, limit: float = DATASET_LIMIT) -> DataFrame:
    """One row: share of drifted columns, dataset verdict, and the columns, largest score first."""
    entry = F.struct(
        (-F.col("drift_score")).alias("order"),
        F.struct(
            F.col("column_name").alias("name"), "drift_detected", F.round("drift_score", 6).alias("drift_score"), "stattest"
        ).alias("entry"),
    )
    totals = columns.agg(
        F.count("*").alias("total_columns"),
        F.count_if("drift_detected").alias("drifted_columns"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias("columns"),
    )
    share = F.coalesce(F.try_divide("drifted_columns", "total_columns"), F.lit(0.0))
    return totals.select(
        (share >= limit).alias("dataset_drift_detected"),
        F.lit(limit).alias("drift_threshold"),
        "total_columns",
        "drifted_columns",
        share.alias("drift_share"),
        "columns",
    )
