"""Bringing stored tables up to date after a load, without building them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill import schemas
from reviewmill.operators import product_features
from reviewmill.session import settle
from reviewmill.sources.writers import table_at


def refresh_features(spark: SparkSession, path: str, reviews: DataFrame, loaded: DataFrame) -> DataFrame:
    """Bring the stored feature table up to date after ``loaded``, rows that ``reviews`` already has.

    The days (asin, date) of the loaded rows are worked out again from all their reviews, and the rolling means of them and
    of the following rows of the product within the window; nothing else is. Texts are read for those days only. Just the
    folders of the dates concerned are written again. Everything is derived from ``reviews`` and the stored table, so a
    refresh that failed half way, or that is repeated, ends at the same table. Returns the (asin, date) rows written anew.
    """
    keys = ["asin", "date"]
    day = F.to_date("timestamp").alias("date")
    touched = settle(loaded.select("asin", day).filter("asin IS NOT NULL AND date IS NOT NULL").distinct(), "touched")
    theirs = reviews.join(touched.select("asin").distinct(), "asin", "left_semi")
    days = theirs.select("asin", day, "rating").filter("date IS NOT NULL").groupBy(*keys).agg(
        F.try_divide(F.sum("rating"), F.count("rating")).alias("rating_avg"), F.count("rating").alias("review_count")
    )
    marked = days.join(touched.withColumn("fresh", F.lit(1)), keys, "left")
    near = Window.partitionBy("asin").orderBy("date").rowsBetween(1 - product_features.ROLLING_ROWS, 0)
    rolled = product_features.with_rolling_means(marked).withColumn("reached", F.max("fresh").over(near))
    rolled = settle(rolled.filter("reached = 1").select(*keys, "fresh", "daily_sentiment_avg", "review_velocity"), "rolled")

    of_days = reviews.withColumn("date", F.to_date("timestamp")).join(touched, keys, "left_semi").drop("date")
    anew = product_features.daily_features(of_days).withColumn(
        "negative_ratio", F.try_divide("negative_count", "review_count")
    )
    anew = product_features.with_entity_json(anew).select(*keys, "negative_ratio", "complaint_keywords", "ner_entities")
    # dates are collected for the scan to leave out folders; there are as many as days, not rows
    dates = [row["date"] for row in rolled.select("date").distinct().collect()]
    stored = table_at(spark, path, schemas.PRODUCT_FEATURES).filter(F.col("date").isin(dates))
    columns = [f.name for f in schemas.PRODUCT_FEATURES.fields]
    means = rolled.select(*keys, "fresh", "daily_sentiment_avg", "review_velocity")
    fresh = means.filter("fresh = 1").join(anew, keys).select(columns)
    later = means.filter("fresh IS NULL").join(stored.drop("daily_sentiment_avg", "review_velocity"), keys).select(columns)
    others = stored.join(rolled, keys, "left_anti").select(columns)
    after = settle(schemas.conform(fresh.unionByName(later).unionByName(others), schemas.PRODUCT_FEATURES), "refreshed")
    if dates:
        writer = after.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("date").parquet(path)
    return rolled.select(*keys)
