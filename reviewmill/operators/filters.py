"""Row filters over reviews and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions import text as tx


def sentiment_band(reviews: DataFrame, band: str) -> DataFrame:
    """negative: rating <= 2; mixed: rating <= 3; positive: rating >= 4. Null ratings belong to none."""
    rating = F.col("rating")
    return reviews.filter({"negative": rating <= 2, "mixed": rating <= 3, "positive": rating >= 4}[band])


def usable_text(reviews: DataFrame, longer_than: int = 30) -> DataFrame:
    return reviews.filter(F.col("text").isNotNull() & (F.length("text") > longer_than))


def mentions_any(reviews: DataFrame, phrases: list[str] = vocab.SHIPPING_PHRASES) -> DataFrame:
    return reviews.filter(tx.contains_any(F.col("text"), phrases))


def alerts_by_severity(alerts: DataFrame, severity: str | None = None) -> DataFrame:
    return alerts if severity is None else alerts.filter(F.col("severity") == severity)


def alerts_of_product(alerts: DataFrame, product_id: str) -> DataFrame:
    return alerts.filter(F.col("product_id") == product_id)


def rating_range(low: float | None, high: float | None) -> Column:
    """Inclusive bounds on rating; None leaves a side open."""
    condition = F.lit(True)
    if low is not None:
        condition = condition & (F.col("rating") >= low)
    if high is not None:
        condition = condition & (F.col("rating") <= high)
    return condition


def with_votes(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("helpful_votes") > 0)
