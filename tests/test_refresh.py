import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill import schemas
from reviewmill.operators import product_features, refresh
from reviewmill.sources import writers

TEXTS = ["battery died, waste of money", "great screen", None, "", "charger stopped working and the cable is loose"]


def reviews(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [
        (i, f"B{rng.integers(0, 6)}" if i % 50 else None, float(rng.integers(1, 6)) if i % 17 else None, TEXTS[i % 5], int(rng.integers(0, 40)))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id long, asin string, rating double, text string, day int")
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("day") * 86_400 + F.col("id") % 3600)
    return df.withColumn("timestamp", F.when(F.col("id") % 31 != 0, when)).drop("day")


def full(df, path):
    writers.replace_features(product_features.with_entity_json(product_features.product_features(df)), path)


def rows_at(spark, path):
    found = spark.read.schema(schemas.PRODUCT_FEATURES).parquet(path).collect()
    exact = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(exact(r[f.name]) for f in schemas.PRODUCT_FEATURES.fields) for r in found), key=repr)


def files(path):
    return {
        os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


@pytest.mark.parametrize("second", ["id % 10 = 3", "id > 390", "asin = 'B2' OR asin IS NULL", "id >= 0", "rating = 1"])
def test_two_loads_equal_one(spark, tmp_path, second):
    every, stepwise, whole = reviews(spark), str(tmp_path / "stepwise"), str(tmp_path / "whole")
    full(every.filter(f"NOT coalesce({second}, false)"), stepwise)
    loaded = every.filter(second)
    refresh.refresh_features(spark, stepwise, every, loaded)
    full(every, whole)
    assert rows_at(spark, stepwise) == rows_at(spark, whole)
    refresh.refresh_features(spark, stepwise, every, loaded)  # a repeated refresh changes nothing
    assert rows_at(spark, stepwise) == rows_at(spark, whole)


def test_other_dates_are_left_alone(spark, tmp_path):
    every, path = reviews(spark), str(tmp_path / "features")
    late = every.filter("asin = 'B1' AND timestamp >= '2023-12-10'").limit(3)
    loaded = spark.createDataFrame(late.collect(), every.schema)
    full(every.join(loaded.select("id"), "id", "left_anti"), path)
    before = files(path)
    written = refresh.refresh_features(spark, path, every, loaded)
    dates = {str(r["date"]) for r in written.collect()}
    after = files(path)
    same = {name for name in before if after.get(name) == before[name]}
    assert same and all(name.split("/")[0].removeprefix("date=") not in dates for name in same)
    changed = {name.split("/")[0].removeprefix("date=") for name in set(after) - same}
    assert changed == dates and len(dates) <= 3 * product_features.ROLLING_ROWS
    assert {r["asin"] for r in written.collect()} == {"B1"}


def test_first_load_and_nothing_to_load(spark, tmp_path):
    every, path, whole = reviews(spark, 60), str(tmp_path / "features"), str(tmp_path / "whole")
    refresh.refresh_features(spark, path, every, every)
    full(every, whole)
    assert rows_at(spark, path) == rows_at(spark, whole)
    before = files(path)
    assert refresh.refresh_features(spark, path, every, every.limit(0)).collect() == []
    assert files(path) == before
