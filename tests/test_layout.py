import re

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import product_features
from reviewmill.session import new_path
from reviewmill.sources import layout


@pytest.fixture(scope="module")
def stored(spark):
    asin = F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 50 != 1, F.concat(F.lit("B"), (F.col("id") % 97).cast("string")))
    reviews = spark.range(3000).select(
        "id", asin.alias("asin"), (F.col("id") % 5 + 1).cast("double").alias("rating"),
        F.when(F.col("id") % 4 == 0, "battery died").otherwise("fine screen").alias("text"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 30) * 86_400).alias("timestamp"),
    )
    return reviews, layout.write_layout(reviews, "laid_out_reviews", new_path(spark, "layout"), 8)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange \w+", plan), plan


def rows(df):
    return sorted(map(repr, df.collect()))


def test_every_row_is_stored_once_and_hot_products_apart(stored):
    reviews, laid = stored
    assert rows(laid.reviews.select(reviews.columns)) == rows(reviews)
    assert {r["asin"] for r in laid.apart.select("asin").distinct().collect()} == {"HOT", None}
    assert laid.bucketed.groupBy("asin").count().agg(F.max("count")).first()[0] <= 3000 / 32


def test_features_and_windows_by_product_shuffle_nothing(stored):
    reviews, laid = stored
    for entities in (False, True):
        daily = product_features.daily_features(laid.bucketed, entities, together=True)
        rolled = product_features.with_rolling_means(daily)
        for df in (daily, rolled):
            found, plan = exchanges(df)
            assert found == [] and "Bucketed: true" in plan
        whole = laid.by_product(lambda r, together: product_features.with_rolling_means(product_features.daily_features(r, entities, together)))
        plain = product_features.with_rolling_means(product_features.daily_features(reviews, entities))
        assert rows(whole) == rows(plain)


def test_joins_by_product_shuffle_the_other_side_only(spark, stored):
    _, laid = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = spark.range(97).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("asin"), F.col("id").alias("n"))
        joined = laid.bucketed.select("asin", "rating").join(other, "asin")
        found, plan = exchanges(joined)
        assert len(found) == 1 and "Bucketed: true" in plan
        assert joined.count() == laid.bucketed.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_table(spark, stored):
    reviews, _ = stored
    laid = layout.write_layout(reviews.limit(0), "laid_out_nothing", new_path(spark, "layout"), 4)
    assert laid.reviews.collect() == [] and layout.read_layout(spark, "laid_out_nothing").apart.columns == reviews.columns


def test_rows_are_stored_by_the_tasks_that_read_them(spark, stored):
    reviews, _ = stored
    read = reviews.repartition(5, "id").withColumn("task", F.spark_partition_id())
    laid = layout.write_layout(read, "laid_out_in_place", new_path(spark, "layout"), 4)
    assert rows(laid.reviews.select(reviews.columns)) == rows(reviews)
    for part in (laid.bucketed, laid.apart):
        files = part.groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("task").alias("tasks")).collect()
        assert {f["tasks"] for f in files} == {1} and part.select("task").distinct().count() == 5
    for file in {f for f in laid.bucketed.inputFiles()}:
        found = [(r["asin"], r["timestamp"]) for r in spark.read.parquet(file).select("asin", "timestamp").collect()]
        assert found == sorted(found)
