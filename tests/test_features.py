import datetime

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import product_features, ranking

DAY = datetime.datetime(2024, 1, 1, 12)


def reviews(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "id long, asin string, timestamp timestamp, rating double, text string")


def day(n):
    return DAY + datetime.timedelta(days=n)


def test_null_keys_and_null_ratings(spark):
    df = reviews(spark, [
        ("a", day(0), 1.0, "battery died, refund"), ("a", day(0), 5.0, "battery fine"), ("a", day(0), None, "broken"),
        ("a", day(1), None, None), (None, day(0), 1.0, "x"), ("a", None, 1.0, "x"),
    ])
    rows = {r["date"].day: r for r in product_features.product_features(df).collect()}
    assert set(rows) == {1, 2}
    first, second = rows[1], rows[2]
    assert first["daily_sentiment_avg"] == 3.0 and first["negative_ratio"] == 0.5 and first["review_velocity"] == 2.0
    assert first["complaint_keywords"] == 2 and first["components"] == {"battery": 2}
    assert first["issues"] == {"broken": 1, "died": 1, "refund": 1}
    assert second["negative_ratio"] is None and second["review_velocity"] == 1.0 and second["daily_sentiment_avg"] == 3.0


def test_windows_count_rows_not_days(spark):
    df = reviews(spark, [("a", day(10 * i), float(i % 5 + 1), "t") for i in range(9)])
    rows = product_features.product_features(df).orderBy("date").collect()
    ratings = [i % 5 + 1 for i in range(9)]
    for i, row in enumerate(rows):
        window = ratings[max(0, i - 6): i + 1]
        assert row["daily_sentiment_avg"] == pytest.approx(sum(window) / len(window))


def test_merge_counts(spark):
    df = spark.sql("SELECT map('a', 1L, 'b', 2L) AS x, map('b', 3L, 'c', 4L) AS y")
    merged = df.select(product_features.merge_counts(F.col("x"), F.col("y")).alias("m")).first()["m"]
    assert merged == {"a": 1, "b": 5, "c": 4}


def test_newest_first_with_a_hot_product(spark):
    rows = [("hot" if i % 3 else f"p{i % 7}", None if i % 11 == 0 else day(i % 20), 1.0, "t") for i in range(600)]
    df = reviews(spark, rows)
    got = {(r["asin"], r["id"]): r["position"] for r in ranking.newest_first(df.repartition(5)).collect()}
    by_asin = {}
    for i, (asin, time, *_) in enumerate(rows):
        by_asin.setdefault(asin, []).append((time is None, -(time or DAY).timestamp(), i))
    want = {(a, k[2]): n for a, keys in by_asin.items() for n, k in enumerate(sorted(keys), 1)}
    assert got == want


def test_texts_are_searched_once(spark):
    df = reviews(spark, [("a", DAY, 1.0, "t")])
    plan = product_features.product_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2


def test_top_per_group_is_limited_before_the_shuffle(spark):
    df = reviews(spark, [("a", DAY, 1.0, "t")]).withColumn("helpful_votes", F.lit(1))
    plan = ranking.most_helpful(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
