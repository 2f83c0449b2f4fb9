import numpy as np
import pytest

from reviewmill.operators import anomaly, autoencoder

COLUMNS = ["a", "b", "c", "d"]


def curved(spark, n=1500, seed=2):
    """Four columns that follow one number along a curve."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(-1, 1, n)
    data = np.stack([t, t**2, np.sin(3 * t), np.cos(4 * t)], 1) + 0.02 * rng.normal(size=(n, 4))
    return spark.createDataFrame([(f"p{i}", *row) for i, row in enumerate(data.tolist())], "asin string, a double, b double, c double, d double")


def test_curves_are_followed_better_than_by_planes_and_in_any_layout(spark):
    df = curved(spark)
    options = {"hidden": (16, 2, 16), "epochs": 30, "batch_rows": 32, "rate": 0.01}
    model = autoencoder.fit(df.repartition(3), COLUMNS, **options)
    mine = autoencoder.autoencoder_scores(df, model).agg({"anomaly_score": "avg"}).first()[0]
    plane = anomaly.reconstruction_scores(df, COLUMNS, k=2).agg({"anomaly_score": "avg"}).first()[0]
    assert mine < 0.7 * plane and model.losses[-1] < 0.2 * model.losses[0]
    again = autoencoder.fit(df.repartition(7, "asin"), COLUMNS, **options)
    assert again.weights == pytest.approx(model.weights, abs=1e-6)


def test_shards_are_averaged(spark):
    df = curved(spark, 900)
    model = autoencoder.fit(df, COLUMNS, hidden=(8, 2, 8), epochs=12, batch_rows=16, shard_rows=120, rate=0.01)
    assert model.losses[-1] < 0.6 * model.losses[0]


def test_gradient_is_that_of_the_error():
    network, rng = autoencoder.Network((3, 4, 2, 3)), np.random.default_rng(1)
    weights, rows = network.start(3) + 0.1 * rng.normal(size=network.size), rng.normal(size=(5, 3))
    loss, gradient = network.gradient(weights, rows)
    for i in range(network.size):
        near = [network.gradient(weights + step * np.eye(network.size)[i], rows)[0] for step in (1e-5, -1e-5)]
        assert gradient[i] == pytest.approx((near[0] - near[1]) / 2e-5, abs=1e-6)
    assert loss == pytest.approx(np.mean((network.outputs(weights, rows)[-1] - rows) ** 2))


def test_outliers_missing_values_and_empty_tables(spark):
    df = curved(spark, 400)
    odd = spark.createDataFrame([("odd", 5.0, -5.0, 5.0, 5.0), ("none", None, None, None, float("nan"))], df.schema)
    model = autoencoder.fit(df, COLUMNS, hidden=(8, 2, 8), epochs=8, batch_rows=32, rate=0.01)
    scores = {r["asin"]: r["anomaly_score"] for r in autoencoder.autoencoder_scores(df.union(odd), model).collect()}
    assert max(scores, key=scores.get) == "odd" and np.isfinite(scores["none"])
    empty = autoencoder.fit(df.limit(0), COLUMNS)
    assert empty.losses == [] and autoencoder.autoencoder_scores(df.limit(0), empty).collect() == []
