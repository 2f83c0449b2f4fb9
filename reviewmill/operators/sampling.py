"""Repeatable samples, ordered heads and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions import selection
from reviewmill.operators import filters, joins


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly ``n`` rows in the order of a hash of key and seed: the same rows on every run and layout."""
    return selection.top_rows(df, n, selection.hash_key(F.col(key), seed=seed), F.col(key), bounds=selection.HASH_BOUNDS)


def labelling_candidates(reviews: DataFrame) -> DataFrame:
    """All usable negative reviews."""
    return filters.usable_text(filters.sentiment_band(reviews, "negative"), 50)


def negative_sample(reviews: DataFrame, n: int, seed: int = 42, done: DataFrame | None = None) -> DataFrame:
    """``n`` usable negative reviews to be labelled; those in ``done`` go first, so a later run goes on with others."""
    return _sample_ids(labelling_candidates(reviews), done, n, seed)


def review_sample(reviews: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return sample(reviews, n, seed)


def worst_first(reviews: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest-rated usable reviews with rating <= 3, ties by id."""
    usable = filters.usable_text(filters.sentiment_band(reviews, "mixed"), 30)
    thousandths = F.round(F.col("rating") * 1000).cast("long")
    return selection.top_rows(usable, n, thousandths, F.col("id"), prune=lambda cut: F.col("rating") <= (cut + 1) / 1000)


def shipping_candidates(reviews: DataFrame, done: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Unlabelled negative reviews that mention shipping. Labelled ones go first, so the sample is never short."""
    return _sample_ids(filters.mentions_any(labelling_candidates(reviews)), done, n, seed)


def _sample_ids(rows: DataFrame, done: DataFrame | None, n: int, seed: int) -> DataFrame:
    """A sample of the rows that are not done: only ids are compared and drawn, the texts of the chosen ones are joined."""
    ids = rows.select("id")
    chosen = sample(ids if done is None else joins.not_done(ids, done, "id"), n, seed)
    return rows.join(chosen, "id", "left_semi")


def latest_alerts(alerts: DataFrame, limit: int = 50, severity: str | None = None) -> DataFrame:
    """The newest ``limit`` alerts."""
    chosen = filters.alerts_by_severity(alerts, severity)
    return chosen.orderBy(F.desc("detected_at"), "product_id", "details").limit(limit)


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in a given order; for small ``n`` (a bounded heap per task)."""
    return df.orderBy(*order).limit(n)


def split_bucket(key: Column, seed: int = 42) -> Column:
    """0..99 from a hash of the key: independent of partitioning and of the other rows."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
                  .cast("long"), F.lit(100))


def with_split(df: DataFrame, key: str = "id", seed: int = 42, **shares: int) -> DataFrame:
    """A ``split`` column by percentage, e.g. ``train=70, validation=15, test=15``."""
    shares = shares or {"train": 70, "validation": 15, "test": 15}
    if sum(shares.values()) != 100:
        raise ValueError("shares must add up to 100")
    bucket, column, upper = split_bucket(F.col(key), seed), None, 0
    for name, share in shares.items():
        upper += share
        column = F.when(bucket < upper, name) if column is None else column.when(bucket < upper, name)
    return df.withColumn("split", column)
