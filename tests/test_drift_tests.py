import math

import numpy as np
import pytest

from reviewmill.functions import stats
from reviewmill.operators import drift, drift_tests


def windowed(spark, reference, current, kind="double"):
    rows = [("reference", v) for v in reference] + [("current", v) for v in current]
    return spark.createDataFrame(rows, f"window string, x {kind}").repartition(5)


def result(df, **options):
    return drift_tests.column_tests(df, **({"numeric": ["x"]} | options)).first()


def test_published_tail_values():
    # critical values of the limit distribution, of chi-square and of the normal distribution, as tables print them
    for x, p in ((1.2238, 0.10), (1.3581, 0.05), (1.6276, 0.01), (0.8276, 0.50), (0.5712, 0.90)):
        assert stats.kolmogorov_upper_tail(x) == pytest.approx(p, abs=2e-4)
    for x, df, p in ((3.841, 1, 0.05), (6.635, 1, 0.01), (5.991, 2, 0.05), (7.815, 3, 0.05), (18.307, 10, 0.05), (124.342, 100, 0.05)):
        assert stats.chi_square_upper_tail(x, df) == pytest.approx(p, abs=2e-4)
    for z, p in ((1.95996, 0.05), (2.57583, 0.01)):
        assert stats.normal_two_sided(z) == pytest.approx(p, abs=1e-5)
    assert stats.kolmogorov_upper_tail(0) == 1 and stats.chi_square_upper_tail(math.inf, 3) == 0 and stats.chi_square_upper_tail(0, 3) == 1
    for x in (1.17, 1.18, 1.19):  # both series
        assert stats.kolmogorov_upper_tail(x) == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200)), abs=1e-9)


def test_the_data_choose_the_test():
    chosen = drift_tests.chosen
    assert chosen(False, 6, 1000) == drift_tests.KS and chosen(False, 6, 1001) == drift_tests.WASSERSTEIN
    assert chosen(False, 5, 1000) == chosen(True, 40, 1000) == drift_tests.CHI_SQUARE
    assert chosen(True, 2, 1000) == chosen(False, 2, 10) == drift_tests.Z_TEST
    assert chosen(True, 40, 1001) == chosen(False, 5, 1001) == drift_tests.JENSEN_SHANNON


def test_kolmogorov_smirnov(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=400).round(2), rng.normal(0.3, 1, size=300).round(2)
    row = result(windowed(spark, a.tolist() + [None], b.tolist()))
    gap = max(abs((a <= x).mean() - (b <= x).mean()) for x in np.concatenate([a, b]))
    assert row["stattest"] == drift_tests.KS and row["statistic"] == pytest.approx(gap)
    assert row["drift_score"] == pytest.approx(stats.kolmogorov_upper_tail(math.sqrt(400 * 300 / 700) * gap)) and row["drift_detected"]
    same = result(windowed(spark, a.tolist(), a.tolist()))
    assert same["statistic"] == 0 and same["drift_score"] == 1 and not same["drift_detected"]


def test_categories(spark):
    a, b = ["u"] * 50 + ["v"] * 30 + ["w"] * 20, ["u"] * 20 + ["v"] * 30 + ["w"] * 10
    row = result(windowed(spark, a, b, "string"), numeric=[], categorical=["x"])
    wanted = sum((c - 60 * r / 100) ** 2 / (60 * r / 100) for r, c in ((50, 20), (30, 30), (20, 10)))
    assert row["stattest"] == drift_tests.CHI_SQUARE and row["statistic"] == pytest.approx(wanted)
    assert row["drift_score"] == pytest.approx(math.exp(-wanted / 2)) and row["drift_detected"]
    new = result(windowed(spark, a, b + ["new"], "string"), numeric=[], categorical=["x"])
    assert new["drift_score"] == 0 and new["drift_detected"]
    large = result(windowed(spark, a, b, "string"), numeric=[], categorical=["x"], small_rows=99)
    p, q = np.array([0.5, 0.3, 0.2]), np.array([20, 30, 10]) / 60
    m = (p + q) / 2
    assert large["stattest"] == drift_tests.JENSEN_SHANNON
    assert large["drift_score"] == pytest.approx(math.sqrt((p @ np.log(p / m) + q @ np.log(q / m)) / 2))


def test_two_values(spark):
    row = result(windowed(spark, [0.0] * 60 + [1.0] * 40, [0.0] * 45 + [1.0] * 55))
    both = 105 / 200
    assert row["stattest"] == drift_tests.Z_TEST
    assert row["statistic"] == pytest.approx((0.6 - 0.45) / math.sqrt(both * (1 - both) * 2 / 100)) and row["drift_detected"]
    assert result(windowed(spark, [1.0] * 9, [1.0] * 9))["drift_score"] == 1


def test_distance_equals_the_other_function_and_empty_windows(spark):
    rng = np.random.default_rng(4)
    df = windowed(spark, rng.exponential(size=300).tolist(), (rng.exponential(size=200) + 0.4).tolist())
    row = result(df, small_rows=100)
    assert row["drift_score"] == pytest.approx(drift.column_drift(df, ["x"]).first()["drift_score"]) and row["drift_detected"]
    for a, b in (([], []), ([1.0, 2.0], []), ([], [1.0]), ([None], [None])):
        got = result(windowed(spark, a, b))
        assert got["drift_score"] is None and not got["drift_detected"]
