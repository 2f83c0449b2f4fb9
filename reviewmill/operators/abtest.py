"""Comparing two model variants by judged scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions.stats import t_upper_tail_column
from reviewmill.operators import joins

TARGET = 4.0
METRICS = [*vocab.CRITERIA, "overall_score"]


def mean_scores(evaluations: DataFrame, target: float = TARGET) -> DataFrame:
    """Mean per criterion and overall for each model, PASS above the target."""
    overall = F.avg("overall_score")
    return evaluations.groupBy("model_name").agg(
        F.count("*").alias("evaluated"),
        *(F.avg(c).alias(c) for c in vocab.CRITERIA),
        overall.alias("overall_score"),
        F.when(overall > target, "PASS").otherwise("FAIL").alias("verdict"),
    )


def compare(evaluations: DataFrame, base: str, tuned: str) -> DataFrame:
    """Per metric: means, difference and the independent equal-variance t statistic over common asins.

    Means and variances are Spark's, which merge partial results without cancellation. Without any variance the
    statistic is infinite with the sign of the difference, or NaN if there is no difference either.
    """
    rows = evaluations.filter(F.col("asin").isNotNull())
    both = joins.scored_by_both(rows, base, tuned)
    measures = [f(m).alias(f"{p}_{m}") for m in METRICS for p, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    sides = both.groupBy("model_name").agg(*measures)
    listed = ", ".join(f"'{m}', n_{m}, m_{m}, v_{m}" for m in METRICS)
    long = sides.selectExpr("model_name", f"stack({len(METRICS)}, {listed}) AS (metric, n, m, v)")
    # counted beside the sums, not among them: a distinct count would make Spark group all of them by asin first
    asins = joins.common_asins(rows, base, tuned).agg(F.count("*").alias("common_products"))
    asins = asins.select("common_products", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))

    def side(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model_name") == model, F.col(column)))

    pairs = long.groupBy("metric").agg(
        *(side(model, c).alias(p + c) for p, model in (("b", base), ("t", tuned)) for c in ("n", "m", "v")),
    ).join(asins, "metric")
    freedom = F.col("bn") + F.col("tn") - 2
    spread = F.coalesce((F.col("bn") - 1) * F.col("bv"), F.lit(0.0)) + F.coalesce((F.col("tn") - 1) * F.col("tv"), F.lit(0.0))
    error = F.sqrt(F.try_divide(spread, freedom) * (1 / F.col("bn") + 1 / F.col("tn")))
    difference = F.col("tm") - F.col("bm")
    without_spread = (
        F.when(difference > 0, F.lit(float("inf"))).when(difference < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    )
    return pairs.filter("bn > 0 AND tn > 0").select(
        "metric",
        "common_products",
        F.col("bm").alias("base_mean"),
        F.col("tm").alias("tuned_mean"),
        difference.alias("difference"),
        F.when(error == 0, without_spread).otherwise(difference / F.nullif(error, F.lit(0.0))).alias("t_stat"),
        freedom.alias("freedom"),
    )


def significance(compared: DataFrame, level: float = 0.05) -> DataFrame:
    """One-sided p-value ("tuned is greater") of the five metric rows."""
    tail = t_upper_tail_column("t_stat", F.col("freedom").cast("double"))
    p_value = F.when(F.isnan("t_stat"), F.col("t_stat")).otherwise(tail)
    return compared.withColumn("p_value", p_value).withColumn("significant", F.col("p_value") < level)


def verdict(tested: DataFrame, needed: int = 2) -> DataFrame:
    return tested.agg(F.count_if("significant").alias("significant_metrics")).withColumn(
        "verdict", F.when(F.col("significant_metrics") >= needed, "PASS").otherwise("FAIL")
    )
