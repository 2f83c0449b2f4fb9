import datetime

import numpy as np

from reviewmill.operators import sketches
from reviewmill.session import new_path


def rows(spark, days, seed=1, n=700):
    rng = np.random.default_rng(seed)
    data = [(datetime.date(2024, 1, 1) + datetime.timedelta(d), float(v)) for d in days for v in rng.lognormal(d / 10, 1, n + 13 * d)]
    return data, spark.createDataFrame(data, "date date, score double").repartition(5)


def off(values, value, fraction):
    """By how much the ranks that a value has miss a fraction."""
    low, high = np.mean(np.array(values) < value), np.mean(np.array(values) <= value)
    return max(0.0, low - fraction, fraction - high)


def test_merged_quantiles_are_within_the_bound(spark):
    data, df = rows(spark, range(20))
    made = sketches.daily_sketches(df, "score")
    assert made.count() == 20
    for first, last in ((None, None), (3, 9), (12, 12)):
        a, b = (None if x is None else datetime.date(2024, 1, 1) + datetime.timedelta(x) for x in (first, last))
        values = [v for d, v in data if (a is None or d >= a) and (b is None or d <= b)]
        for row in sketches.quantiles(made, [0.0, 0.05, 0.5, 0.95, 1.0], a, b).collect():
            assert row["n"] == len(values) and row["value"] in set(values)
            assert off(values, row["value"], row["fraction"]) <= sketches.rank_error()


def test_threshold_reads_sketches_only(spark):
    data, df = rows(spark, range(10))
    path = new_path(spark, "sketches")
    sketches.refresh(spark, path, df.filter("date < '2024-01-06'"), "score")
    more = spark.createDataFrame([(datetime.date(2024, 1, 2), 1e9)], "date date, score double")
    sketches.refresh(spark, path, df.filter("date >= '2024-01-06'"), "score")
    stored = spark.read.parquet(path)
    limit = sketches.threshold(stored, 0.95)
    assert off([v for _, v in data], limit, 0.95) <= sketches.rank_error()
    sketches.refresh(spark, path, more, "score")  # a date is replaced as a whole
    assert {r["date"].day: r["n"] for r in spark.read.parquet(path).collect()}[2] == 1
    assert spark.read.parquet(path).count() == 10


def test_nothing_to_sketch(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1), None), (datetime.date(2024, 1, 1), float("nan"))], "date date, score double")
    made = sketches.daily_sketches(df, "score")
    assert made.collect() == [] and sketches.threshold(made) is None
