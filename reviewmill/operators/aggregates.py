"""Counts, distributions and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions import text as tx
from reviewmill.operators import filters


def row_counts(**tables: DataFrame) -> DataFrame:
    """One row per table with its row count."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def rating_distribution(reviews: DataFrame, *keys: str) -> DataFrame:
    return reviews.groupBy(*keys, "rating").agg(F.count("*").alias("review_count"))


def reviews_per_month(reviews: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "timestamp").cast("date").alias("month")
    return reviews.filter(F.col("timestamp").isNotNull()).groupBy(month).agg(F.count("*").alias("review_count"))


def by_asin_and_title(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Count and rating sums by (asin, product title).

    Reviews are aggregated before the join, so the join sees one row per (asin, parent_asin) and no hot product.
    """
    totals = reviews.groupBy("asin", "parent_asin").agg(
        F.count("*").alias("n"), F.sum("rating").alias("s"), F.count("rating").alias("c")
    )
    titles = products.select("parent_asin", F.col("title").alias("product_title"))
    return (
        totals.join(titles, "parent_asin", "left")
        .groupBy("asin", "product_title")
        .agg(F.sum("n").alias("review_count"), F.sum("s").alias("rating_sum"), F.sum("c").alias("rating_count"))
    )


def top_products(reviews: DataFrame, products: DataFrame, limit: int = 20) -> DataFrame:
    """Most reviewed (asin, title) with the mean rating, halves rounded up."""
    mean = F.round(F.try_divide("rating_sum", "rating_count"), 2).alias("avg_rating")
    ranked = by_asin_and_title(reviews, products).orderBy(F.desc("review_count"), "asin", "product_title")
    return ranked.limit(limit).select("asin", "product_title", "review_count", mean)


def products_with_reviews(
    reviews: DataFrame, products: DataFrame, min_reviews: int = 20, limit: int | None = None
) -> DataFrame:
    """(asin, title) with at least ``min_reviews`` usable reviews; with ``limit`` the most reviewed ones only."""
    usable = filters.usable_text(reviews, 30)
    enough = by_asin_and_title(usable, products).filter(F.col("review_count") >= min_reviews)
    if limit is not None:
        enough = enough.orderBy(F.desc("review_count"), "asin", "product_title").limit(limit)
    return enough.select("asin", "product_title", "review_count")


def label_distribution(labels: DataFrame) -> DataFrame:
    """Positives and percentage per label."""
    sums = labels.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in vocab.LABELS))
    pairs = ", ".join(f"'{c}', {c}" for c in vocab.LABELS)
    return sums.selectExpr("n", f"stack({len(vocab.LABELS)}, {pairs}) AS (label, positives)").select(
        "label", "positives", (F.col("positives") * 100 / F.col("n")).alias("percent")
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alert_count"))


def mean_and_median(values: DataFrame, column: str) -> DataFrame:
    """Mean and exact median of an integer column, from one row per distinct value."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return counts.agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("v", 0.5, F.col("n")).alias("median"),
        F.sum("n").alias("row_count"),
    )


def clipped_histogram(values: DataFrame, column: str, cap: int, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal bins from the smallest to the largest value after clipping; the last bin is closed.

    Rows are first reduced to one per distinct clipped value, at most ``cap`` + 1 of them.
    """
    clipped = F.least(F.col(column), F.lit(cap)).cast("long").alias("v")
    counts = values.filter(F.col(column).isNotNull()).groupBy(clipped).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    ranged = counts.withColumn("lo", F.min("v").over(everything)).withColumn("hi", F.max("v").over(everything))
    index = F.least(F.coalesce(F.expr(f"(v - lo) * {bins} div nullif(hi - lo, 0)"), F.lit(bins // 2)), F.lit(bins - 1))
    filled = ranged.groupBy(index.alias("bin")).agg(F.sum("n").alias("n"))
    all_bins = values.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return all_bins.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("row_count"))


def word_frequencies(reviews: DataFrame, limit: int = 100, stop_words: list[str] = vocab.STOP_WORDS) -> DataFrame:
    """The most frequent words of negative reviews."""
    negative = filters.sentiment_band(reviews, "negative").filter(F.col("text").isNotNull())
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({tx.WORD})"), F.lit(1))
    # An outer explode: for an inner one Spark adds a filter on the array's size, which would split every text twice.
    each = negative.select(F.explode_outer(words).alias("word")).filter(F.col("word").isNotNull())
    counted = each.groupBy("word").agg(F.count("*").alias("word_count"))
    return counted.filter(~F.col("word").isin(stop_words)).orderBy(F.desc("word_count"), "word").limit(limit)


def review_input_counts(reviews: DataFrame) -> DataFrame:
    """Per asin: reviews shown, negative and positive ones."""
    return reviews.groupBy("asin").agg(
        F.count("*").alias("shown"), _count_if(F.col("rating") <= 2, "negative"), _count_if(F.col("rating") >= 4, "positive")
    )


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)
