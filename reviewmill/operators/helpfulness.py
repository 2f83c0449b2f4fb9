"""Helpfulness regression on review style features."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.operators.anomaly import Scaler, fit_scaler

# The feature names, which are output columns.
STYLE = ["text_length", "word_count", "rating", "title_length", "has_exclamation", "has_question",
         "avg_word_length", "uppercase_ratio"]
MAX_ERROR = 2.0


def style_table(reviews: DataFrame, scan: bool = False) -> DataFrame:
    """id, the eight style features and the target votes. Store them for ``fit``, which reads its rows many times; then ``scan``."""
    staged = reviews.withColumn("_text", F.coalesce("text", F.lit("")))
    if scan:
        counted = staged.select("*", tx.scanned_style_inputs(F.col("_text")).alias("_style"))
        staged = counted.select("*", *(F.col(f"_style.{c}").alias(f"_{c}") for c in ("chars", "visible", "words", "letters", "capitals")))
    else:
        staged = staged.select("*", *tx.style_inputs(F.col("_text")))
    return staged.select("id", *tx.style_features(F.col("_text"), F.col("title"), F.col("rating"), scan), "helpful_votes")


def _vectors(df: DataFrame, scaler: Scaler) -> DataFrame:
    scaled = df.select("id", F.col("helpful_votes").cast("double").alias("label"), *(scaler.scaled(c).alias(c) for c in STYLE))
    return VectorAssembler(inputCols=STYLE, outputCol="features").transform(scaled).select("id", "label", "features")


def fit(train: DataFrame, boosted: bool = True) -> tuple[Scaler, Transformer]:
    """A regressor on standardised features; the scaler sees training rows only."""
    known = train.filter(F.col("helpful_votes").isNotNull())
    scaler = fit_scaler(known, STYLE)
    model = GBTRegressor(maxIter=20, maxDepth=4, seed=42) if boosted else LinearRegression(regParam=0.01)
    return scaler, PipelineModel([model.fit(_vectors(known, scaler))])


def predict(scaler: Scaler, model: Transformer, rows: DataFrame) -> DataFrame:
    return model.transform(_vectors(rows, scaler)).select("id", F.col("label").alias("y"), "prediction")


def regression_metrics(predictions: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """Mean squared and mean absolute error, and whether the latter is small enough."""
    gap = F.col("prediction") - F.col("y")
    return predictions.agg(
        F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), (F.avg(F.abs(gap)) < max_error).alias("passed")
    )
