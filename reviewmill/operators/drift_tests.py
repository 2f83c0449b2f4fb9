"""Drift of columns by a test that fits the data: by kind of column, number of values and number of reference rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions import stats
from reviewmill.operators import drift
from reviewmill.session import settle

# Up to so many reference rows a test gives a p-value, above a distance; up to so many values a numeric column
# is treated as a categorical one; limits of p-values (drift below) and distances (drift from there on).
SMALL_ROWS, FEW_VALUES, P_LIMIT, DISTANCE_LIMIT = 1000, 5, 0.05, 0.1
KS, CHI_SQUARE, Z_TEST = "K-S p_value", "chi-square p_value", "Z-test p_value"
WASSERSTEIN, JENSEN_SHANNON = drift.METHOD, "Jensen-Shannon distance"


def chosen(categorical: bool, values: int, reference_rows: int, small_rows: int = SMALL_ROWS) -> str:
    """The test for a column with so many values in the reference."""
    if reference_rows <= small_rows:
        if not categorical and values > FEW_VALUES:
            return KS
        return Z_TEST if values <= 2 else CHI_SQUARE
    return WASSERSTEIN if not categorical and values > FEW_VALUES else JENSEN_SHANNON


def column_tests(
    windowed: DataFrame, numeric: list[str] = vocab.FEATURES, categorical: list[str] = (), small_rows: int = SMALL_ROWS
) -> DataFrame:
    """column_name, stattest, statistic, drift_score, drift_detected for every column of two windows.

    drift_score is the p-value or the distance, statistic the number it comes from. Nulls are left out. A column without
    values in one of the windows has neither and is not flagged. Statistics are aggregations over counts per value; what
    reaches the driver is one row per column.
    """
    numbers, texts = list(numeric), list(categorical)
    spark = windowed.sparkSession
    counts = {}
    if numbers:
        counts["double"] = settle(drift.value_counts(windowed, numbers), "drift-numbers")
    if texts:
        counts["string"] = settle(drift.value_counts(windowed, texts, "string"), "drift-texts")
    rows = []
    for kind, table in counts.items():
        shares = [
            F.count("*").alias("values"), F.count_if(F.col("r") > 0).alias("seen"), F.sum("r").alias("nr"), F.sum("c").alias("nc"),
        ]
        for row in table.groupBy("name").agg(*shares).collect():
            test = chosen(kind == "string", row["seen"], row["nr"], small_rows)
            rows.append({"name": row["name"], "kind": kind, "test": test, "values": row["values"], "nr": row["nr"], "nc": row["nc"]})
    found = {}
    for row in rows:
        found.setdefault((row["kind"], "order" if row["test"] in (KS, WASSERSTEIN) else "cells"), []).append(row["name"])
    statistics = {}
    for (kind, form), names in found.items():
        table = counts[kind].filter(F.col("name").isin(names))
        summed = _ordered(table) if form == "order" else _cells(table, [r for r in rows if r["name"] in names and r["kind"] == kind])
        statistics.update({(kind, r["name"]): r for r in summed.collect()})
    deviations = {}
    if any(row["test"] == WASSERSTEIN for row in rows):
        names = [row["name"] for row in rows if row["test"] == WASSERSTEIN]
        is_reference = F.col("window") == "reference"
        deviations = windowed.agg(*(F.stddev_pop(F.when(is_reference, F.col(c))).alias(c) for c in names)).first().asDict()
    result = [_scored(row, statistics[row["kind"], row["name"]], deviations) for row in rows]
    known = {row["name"] for row in rows}
    result += [(name, None, None, None, False) for name in numbers + texts if name not in known]
    frame = pd.DataFrame(result, columns=["column_name", "stattest", "statistic", "drift_score", "drift_detected"])
    schema = "column_name string, stattest string, statistic double, drift_score double, drift_detected boolean"
    return spark.createDataFrame([tuple(None if x is None or x != x else x for x in r) for r in frame.itertuples(index=False)], schema)


def _ordered(counts: DataFrame) -> DataFrame:
    """The largest gap between the distribution functions, and the area between them."""
    gaps = drift.share_gaps(counts)
    return gaps.groupBy("name").agg(F.max("gap").alias("largest"), F.coalesce(F.sum(F.col("gap") * F.col("step")), F.lit(0.0)).alias("area"))


def _cells(counts: DataFrame, rows: list[dict]) -> DataFrame:
    """Sums over the values of a column: chi-square against the reference shares, the divergences from the mean of both
    distributions, and the shares of the smallest value."""
    nr, nc = (drift.chain([r["name"] for r in rows], {r["name"]: r[n] for r in rows}) for n in ("nr", "nc"))
    p, q = F.col("r") / F.nullif(nr, F.lit(0.0)), F.col("c") / F.nullif(nc, F.lit(0.0))
    shares = counts.select("name", "value", "r", "c", p.alias("p"), q.alias("q"), (F.col("r") * nc / F.nullif(nr, F.lit(0.0))).alias("wanted"))
    middle = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / middle)).otherwise(0.0)
    off = (F.col("c") - F.col("wanted")) * (F.col("c") - F.col("wanted"))
    return shares.groupBy("name").agg(
        F.sum(F.when(F.col("wanted") > 0, off / F.col("wanted")).when(F.col("c") > 0, F.lit(math.inf)).otherwise(0.0)).alias("chi"),
        F.sum(part("p") + part("q")).alias("divergence"),
        F.min_by("p", "value").alias("first_p"), F.min_by("q", "value").alias("first_q"),
    )


def _scored(row: dict, found, deviations: dict) -> tuple:
    """(column_name, stattest, statistic, drift_score, drift_detected)."""
    name, test, nr, nc = row["name"], row["test"], row["nr"], row["nc"]
    if not nr or not nc:
        return name, test, None, None, False
    if test == WASSERSTEIN:
        score = found["area"] / max(deviations[name] or 0.0, drift.MIN_DEVIATION)
        return name, test, found["area"], score, score >= DISTANCE_LIMIT
    if test == JENSEN_SHANNON:
        score = math.sqrt(max(0.0, found["divergence"] / 2))
        return name, test, score, score, score >= DISTANCE_LIMIT
    if test == KS:
        statistic = found["largest"]
        p = stats.kolmogorov_upper_tail(math.sqrt(nr * nc / (nr + nc)) * statistic)
    elif test == CHI_SQUARE:
        statistic = found["chi"]
        p = stats.chi_square_upper_tail(statistic, row["values"] - 1)
    else:
        both = (found["first_p"] * nr + found["first_q"] * nc) / (nr + nc)
        spread = math.sqrt(both * (1 - both) * (1 / nr + 1 / nc))
        statistic = (found["first_p"] - found["first_q"]) / spread if spread else 0.0
        p = stats.normal_two_sided(statistic)
    return name, test, statistic, p, p < P_LIMIT
