import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions.stats import t_upper_tail
from reviewmill.operators import abtest, anomaly, drift, helpfulness, rootcause, search


@pytest.mark.parametrize("t, df, p", [
    (1.812, 10, 0.05), (2.228, 10, 0.025), (6.314, 1, 0.05), (1.645, 1_000_000, 0.05), (2.326, 1_000_000, 0.01),
    (0.0, 7, 0.5), (2.764, 10, 0.01), (1.290, 100, 0.10),
])
def test_t_tail_against_published_tables(t, df, p):
    assert t_upper_tail(t, df) == pytest.approx(p, abs=1.5e-4)
    assert t_upper_tail(-t, df) == pytest.approx(1 - p, abs=1.5e-4)


def feature_rows(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    start = datetime.date(2024, 1, 1)
    rows = [(f"a{i % 20}", start + datetime.timedelta(days=i // 20), *map(float, rng.gamma(2.0, size=3)), int(rng.integers(0, 9)))
            for i in range(n)]
    return spark.createDataFrame(rows, "asin string, date date, " + ", ".join(f"{c} double" for c in vocab.FEATURES[:3]) + ", complaint_keywords long")


def test_scores_and_alerts(spark):
    features = feature_rows(spark).withColumn("constant", F.lit(1.0))
    values = np.array([[r[c] for c in vocab.FEATURES] for r in features.collect()])
    scored = anomaly.mean_square_scores(features)
    z = (values - values.mean(0)) / values.std(0)
    assert np.allclose(sorted(r["anomaly_score"] for r in scored.collect()), sorted((z**2).mean(1)))
    limit = anomaly.threshold(scored)
    assert limit == pytest.approx(np.percentile((z**2).mean(1), 95))
    alerts = anomaly.alerts(anomaly.flag(scored, limit), F.lit(datetime.datetime(2024, 2, 1))).collect()
    assert len(alerts) == 20 and {a["severity"] for a in alerts} <= {"critical", "warning"}
    assert anomaly.fit_scaler(features, ["constant"]).apply(features).first()["z_constant"] == 0.0
    estimate = anomaly.threshold(scored, approximate=True)
    assert estimate == pytest.approx(limit, rel=0.1)


def test_reconstruction_scores_equal_numpy(spark):
    features = feature_rows(spark)
    rows = features.collect()
    values = np.array([[r[c] for c in vocab.FEATURES] for r in rows], dtype=float)
    z = (values - values.mean(0)) / values.std(0)
    basis = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    want = ((z - z @ basis @ basis.T) ** 2).mean(1)
    got = {(r["asin"], r["date"]): r["anomaly_score"] for r in anomaly.reconstruction_scores(features).collect()}
    assert np.allclose([got[(r["asin"], r["date"])] for r in rows], want)


def test_drift_equals_direct_integral(spark):
    features = feature_rows(spark).withColumn("review_velocity", F.col("review_velocity") * F.when(F.col("date") > "2024-01-15", 2).otherwise(1))
    windowed = drift.with_window(features, drift.split_date(features))
    rows = windowed.collect()
    got = {r["column_name"]: r for r in drift.column_drift(windowed).collect()}
    for c in vocab.FEATURES:
        ref = np.sort([float(r[c]) for r in rows if r["window"] == "reference"])
        cur = np.sort([float(r[c]) for r in rows if r["window"] == "current"])
        every = np.sort(np.concatenate([ref, cur]))
        gaps = np.abs(np.searchsorted(ref, every[:-1], "right") / len(ref) - np.searchsorted(cur, every[:-1], "right") / len(cur))
        assert got[c]["drift_score"] == pytest.approx((gaps * np.diff(every)).sum() / max(ref.std(), 0.001))
    assert got["review_velocity"]["drift_detected"]
    summary = drift.drift_summary(drift.column_drift(windowed)).first()
    assert summary["total_columns"] == 4 and summary["columns"][0]["name"] == max(got.values(), key=lambda r: r["drift_score"])["column_name"]


def test_no_drift_against_itself(spark):
    features = feature_rows(spark, 60)
    both = features.withColumn("window", F.lit("reference")).unionByName(features.withColumn("window", F.lit("current")))
    assert all(r["drift_score"] == 0.0 and not r["drift_detected"] for r in drift.column_drift(both).collect())


def test_ab_comparison_uses_common_products_and_all_their_rows(spark):
    rows = [("a", "base", 1.0), ("a", "base", 2.0), ("b", "base", 3.0), ("c", "base", 5.0), ("a", "new", 4.0), ("b", "new", 5.0), ("d", "new", 1.0)]
    df = spark.createDataFrame(rows, "asin string, model_name string, v double")
    df = df.select("asin", "model_name", *(F.col("v").alias(c) for c in abtest.METRICS))
    row = abtest.significance(abtest.compare(df, "base", "new")).filter("metric = 'accuracy'").first()
    a, b = np.array([1.0, 2.0, 3.0]), np.array([4.0, 5.0])
    pooled = (2 * a.var(ddof=1) + b.var(ddof=1)) / 3
    t = (b.mean() - a.mean()) / np.sqrt(pooled * (1 / 3 + 1 / 2))
    assert row["common_products"] == 2 and row["freedom"] == 3 and row["t_stat"] == pytest.approx(t)
    assert row["p_value"] == pytest.approx(t_upper_tail(t, 3)) and row["significant"] == (row["p_value"] < 0.05)


@pytest.mark.parametrize("base, tuned, t", [(3.7, 4.3, np.inf), (2.0, 4.0, np.inf), (4.1, 4.1000001, np.inf), (4.3, 3.7, -np.inf), (4.1, 4.1, np.nan)])
def test_constant_scores(spark, base, tuned, t):
    rows = [(f"a{i}", m, v, v, v, v, v) for i in range(200) for m, v in (("b", base), ("t", tuned))]
    scores = spark.createDataFrame(rows, "asin string, model_name string, " + ", ".join(f"{m} double" for m in abtest.METRICS)).repartition(7)
    tested = abtest.significance(abtest.compare(scores, "b", "t")).collect()
    assert len(tested) == 5
    for row in tested:
        assert row["t_stat"] == t or (np.isnan(t) and np.isnan(row["t_stat"]) and np.isnan(row["p_value"]))
        assert row["significant"] == (t == np.inf)


def test_threshold_ties_and_empty_labels(spark):
    df = spark.createDataFrame([("x", 1, 90), ("x", 0, 10), ("y", 0, 10)], "label string, y int, prob_pct int")
    assert rootcause.best_threshold(rootcause.threshold_sweep(df)).first().asDict() == {"threshold": 30, "macro_f1": 0.5}
    none = df.withColumn("prob_pct", F.lit(0))
    assert rootcause.best_threshold(rootcause.threshold_sweep(none)).first().asDict() == {"threshold": 50, "macro_f1": 0.0}
    rows = {r["label"]: r for r in rootcause.report(df).collect()}
    assert rows["y"]["f1"] == 0.0 and rows["x"]["f1"] == 1.0 and rows["macro avg"]["f1"] == 0.5


def test_classifier_learns_phrases(spark):
    cause = {"defect": "stopped working", "shipping": "arrived damaged", "description": "misleading", "size": "too small", "price": "overpriced"}
    rows = [(i, f"item {i % 17} {cause[label]} today", *(int(label == c) for c in vocab.LABELS)) for i, label in enumerate(vocab.LABELS * 30)]
    df = spark.createDataFrame(rows, "id long, text string, " + ", ".join(f"{c} int" for c in vocab.LABELS))
    text_model, models = rootcause.fit_classifier(df.filter("id < 100"), dims=512, max_iter=10)
    report = rootcause.report(rootcause.predict(text_model, models, df.filter("id >= 100")))
    assert report.filter("label = 'macro avg'").first()["f1"] > 0.95


def test_helpfulness_beats_the_mean(spark):
    rows = [(i, "word " * (i % 30), "t", float(i % 5 + 1), (i % 30) // 2) for i in range(600)]
    df = helpfulness.style_table(spark.createDataFrame(rows, "id long, text string, title string, rating double, helpful_votes int"))
    votes = np.array([r[4] for r in rows])
    for boosted in (False, True):
        scaler, model = helpfulness.fit(df, boosted)
        metrics = helpfulness.regression_metrics(helpfulness.predict(scaler, model, df)).first()
        assert metrics["mae"] < 0.6 * np.abs(votes - votes.mean()).mean() and metrics["passed"]


def test_search_filters_before_the_top(spark):
    rows = [("rev_1", 5.0, [1.0, 0.0]), ("rev_2", 1.0, [0.9, 0.1]), ("rev_3", 1.0, [0.0, 1.0]), ("rev_4", 1.0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, rating double, vec array<float>")
    df = df.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    assert [r["id"] for r in search.search(df, [1.0, 0.0], 1, None, 2.0).collect()] == ["rev_2"]
    assert [r["id"] for r in search.search(df, [1.0, 0.0], 9).collect()] == ["rev_1", "rev_2", "rev_3"]
    queries = spark.createDataFrame([(7, [0.0, 2.0]), (8, [0.0, 0.0])], "query_id long, vec array<float>")
    many = search.search_many(df, queries, 2).orderBy("position").collect()
    assert [(r["query_id"], r["id"]) for r in many] == [(7, "rev_3"), (7, "rev_2")]
    assert search.search(df.filter("id <> 'rev_4'"), [2.0, 0.0], 2).collect()[0]["distance"] == pytest.approx(0.0)


def test_more_queries_than_a_block(spark):
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(size=(60, 8)), np.repeat(rng.normal(size=(1, 8)), 30, 0)])
    rows = [(f"rev_{i}", v.tolist(), float(np.sqrt(v @ v))) for i, v in enumerate(vectors)] + [("rev_x", [0.0] * 8, 0.0)]
    records = spark.createDataFrame(rows, "id string, vec array<double>, norm double")
    asked = [*rng.normal(size=(40, 8)), vectors[-1]]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    got = search.search_many(records, queries, 5, block_rows=16).orderBy("query_id", "position").collect()
    for number, v in enumerate(asked):
        every = [(round(1 - float(v @ x) / np.sqrt(v @ v) / norm, 9), id) for id, x, norm in rows[:-1] for x in [np.array(x)]]
        mine = [(r["position"], round(r["distance"], 9), r["id"]) for r in got if r["query_id"] == number]
        assert mine == [(k + 1, d + 0.0, id) for k, (d, id) in enumerate(sorted(every)[:5])]


def test_ten_thousand_queries_are_no_limit(spark):
    records = spark.createDataFrame([("rev_1", [1.0, 0.0], 1.0), ("rev_2", [0.0, 2.0], 2.0)], "id string, vec array<double>, norm double")
    queries = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("vec"))
    got = search.search_many(records, queries, 1)
    assert got.count() == 10_001 and [r["id"] for r in got.select("id").distinct().collect()] == ["rev_1"]


def test_text_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(1, "battery died"), (2, "screen fine"), (3, None)], "id long, text string")
    for row in search.text_vectors(df).collect():
        assert len(row["vec"]) == 384
        assert np.linalg.norm(row["vec"]) == pytest.approx(1.0 if row["text"] else 0.0, abs=1e-6)
