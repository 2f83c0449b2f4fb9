import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.functions import selection
from reviewmill.operators import sampling
from reviewmill.sources import readers


def test_top_rows_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 5)) * 10**12, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a long, b int").repartition(7)
    for n in (0, 1, 99, 100, 250, 499, 500, 900):
        got = selection.top_rows(df, n, F.col("a"), F.col("id")).collect()
        want = sorted(rows, key=lambda r: (r[1], r[0]))[:n]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_rows_with_equal_keys_fills_exactly(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(0,)] * 10, "k long")
    got = [r["k"] for r in selection.top_rows(df, 25, F.col("k")).collect()]
    assert sorted(got) == [0] * 10 + [1] * 15


@pytest.mark.parametrize("name", ["uniform", "tail", "constant", "few", "negative"])
def test_exact_percentile(spark, name):
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.uniform(size=1001),
        "tail": np.exp(rng.normal(0, 12, size=777)),
        "constant": np.full(10, 4.5),
        "few": np.array([1.0, 2.0]),
        "negative": -np.abs(rng.normal(size=300)).round(1),
    }[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "s double").repartition(5)
    for p in (0.0, 0.25, 0.5, 0.95, 1.0):
        assert selection.exact_percentile(df, "s", p) == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


@pytest.mark.parametrize("values", [[1.0, 2.0, np.nan, 3.0], [-np.inf, 1.0, 2.0, np.inf], [-1.7e308, 0.0, 1.7e308], [np.inf, np.inf]])
def test_percentile_of_values_out_of_range(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for p in (0.0, 0.5, 1.0):
        with np.errstate(invalid="ignore"):
            want = np.percentile(values, p * 100)
        got = selection.exact_percentile(df, "s", p)
        assert got == want or (np.isnan(want) and (np.isnan(got) or np.inf in values))


def test_top_rows_settles_little_and_deletes_it(spark, monkeypatch):
    written = []
    settle_at = selection.settle_at
    monkeypatch.setattr(selection, "settle_at", lambda df, path: written.append((path, df.count())) or settle_at(df, path))
    df = spark.range(20_000).withColumn("k", F.col("id") * 1_000_003)
    got = {r["id"] for r in selection.top_rows(df, 777, F.col("k")).collect()}
    assert got == set(range(777))
    ((path, rows),) = written
    assert rows <= 20 and not os.path.exists(path)


def test_percentile_of_nothing(spark):
    assert selection.exact_percentile(spark.createDataFrame([], "s double"), "s", 0.5) is None


def test_latest_reviews(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 5 == 0 else day + datetime.timedelta(days=i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp")
    known = sorted((r for r in rows if r[1]), key=lambda r: (-r[1].timestamp(), r[0])) + [r for r in rows if not r[1]]
    for n in (3, 17, 36):
        assert {r["id"] for r in readers.latest_reviews(df, n).collect()} == {r[0] for r in known[:n]}


def test_samples_do_not_depend_on_layout(spark):
    df = spark.range(2000)
    a = {r["id"] for r in sampling.sample(df.repartition(3), 100).collect()}
    b = {r["id"] for r in sampling.sample(df.repartition(11), 100).collect()}
    assert a == b and len(a) == 100
    assert a != {r["id"] for r in sampling.sample(df, 100, seed=7).collect()}


def test_splits_cover_and_are_disjoint(spark):
    counts = {r["split"]: r["count"] for r in sampling.with_split(spark.range(5000)).groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000 and set(counts) == {"train", "validation", "test"}
    assert 3300 < counts["train"] < 3700
    with pytest.raises(ValueError):
        sampling.with_split(spark.range(1), train=50)
