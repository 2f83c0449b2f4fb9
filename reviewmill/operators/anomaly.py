"""Anomalous product days: standardise, score, flag, write alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions import selection

PERCENTILE = 0.95


@dataclass
class Scaler:
    """Mean and population standard deviation per column; a constant column is only centred."""

    means: dict[str, float]
    stds: dict[str, float]

    def scaled(self, column: str) -> Column:
        return (F.col(column) - F.lit(self.means[column])) / F.lit(self.stds[column] or 1.0)

    def apply(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.select("*", *(self.scaled(c).alias(prefix + c) for c in self.means))


def fit_scaler(df: DataFrame, columns: list[str] = vocab.FEATURES) -> Scaler:
    """One aggregation over all columns. MLlib's StandardScaler divides by the sample deviation, this by the population's."""
    row = df.agg(
        *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)
    ).first()
    return Scaler({c: row[f"m_{c}"] or 0.0 for c in columns}, {c: row[f"s_{c}"] or 0.0 for c in columns})


def mean_square_scores(features: DataFrame, columns: list[str] = vocab.FEATURES) -> DataFrame:
    """Score = mean squared standardised value. A missing value counts as its column's mean."""
    scaler = fit_scaler(features, columns)
    squares = [F.coalesce(scaler.scaled(c) * scaler.scaled(c), F.lit(0.0)) for c in columns]
    return features.withColumn("anomaly_score", sum(squares, F.lit(0.0)) / F.lit(float(len(columns))))


def reconstruction_scores(features: DataFrame, columns: list[str] = vocab.FEATURES, k: int = 2) -> DataFrame:
    """Score = mean squared error after projection on the first ``k`` principal components (a linear autoencoder).

    The fit is distributed and leaves only a columns x k matrix, from which the residual is a plain expression.
    """
    scaled = fit_scaler(features, columns).apply(features).na.fill(0.0, [f"z_{c}" for c in columns])
    names = [f"z_{c}" for c in columns]
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(scaled.select(*names))
    basis = PCA(k=k, inputCol="v", outputCol="p").fit(vectors).pc.toArray()
    projection = basis @ basis.T
    residuals = [
        F.col(name) - sum((F.lit(float(projection[i, j])) * F.col(other) for j, other in enumerate(names)), F.lit(0.0))
        for i, name in enumerate(names)
    ]
    score = sum((r * r for r in residuals), F.lit(0.0)) / F.lit(float(len(names)))
    return scaled.withColumn("anomaly_score", score).drop(*names)


def threshold(scores: DataFrame, fraction: float = PERCENTILE, approximate: bool = False) -> float | None:
    """The percentile of the scores: exact with interpolation, or a sketch estimate."""
    if approximate:
        return scores.agg(F.percentile_approx("anomaly_score", fraction, 100_000)).first()[0]
    return selection.exact_percentile(scores, "anomaly_score", fraction)


def flag(scores: DataFrame, limit: float) -> DataFrame:
    """``is_anomaly`` for scores strictly above the limit."""
    return scores.withColumn("threshold", F.lit(limit)).withColumn("is_anomaly", F.col("anomaly_score") > limit)


def alerts(flagged: DataFrame, detected_at: Column) -> DataFrame:
    """One alert per anomalous product day: critical above twice the threshold, else warning."""
    details = F.to_json(
        F.struct(
            F.col("anomaly_score").cast("decimal(18,6)").alias("anomaly_score"),
            F.col("threshold").cast("decimal(18,6)").alias("threshold"),
            F.col("date").cast("string").alias("date"),
        )
    )
    return flagged.filter("is_anomaly").select(
        F.col("asin").alias("product_id"),
        F.lit("quality_anomaly").alias("alert_type"),
        F.when(F.col("anomaly_score") > F.col("threshold") * 2, "critical").otherwise("warning").alias("severity"),
        detected_at.alias("detected_at"),
        details.alias("details"),
    )
