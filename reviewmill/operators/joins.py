"""Joins of reviews with products, stored results and other models' scores.

Products and result tables grow with the data, so no side is marked for broadcast: AQE broadcasts one whose measured size
is small, else both sides are shuffled and the partitions of hot keys are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.sources.readers import unique_products


def with_products(reviews: DataFrame, products: DataFrame, *columns: str) -> DataFrame:
    """Reviews with product columns (prefixed ``product_``); unmatched reviews stay."""
    side = products.select("parent_asin", *(F.col(c).alias(f"product_{c}") for c in columns))
    return reviews.join(side, "parent_asin", "left")


def not_done(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in ``done``; rows with a null key stay."""
    return rows.join(done.select(*keys), list(keys), "left_anti").select(rows.columns)


def common_asins(evaluations: DataFrame, base: str, tuned: str) -> DataFrame:
    """The asins that both models scored, one row each."""
    pair = evaluations.filter(F.col("model_name").isin(base, tuned))
    seen = pair.groupBy("asin").agg(F.max(F.col("model_name") == base).alias("b"), F.max(F.col("model_name") == tuned).alias("t"))
    return seen.filter("b AND t").select("asin")


def scored_by_both(evaluations: DataFrame, base: str, tuned: str) -> DataFrame:
    """Evaluations of the two models, only for asins that both scored."""
    pair = evaluations.filter(F.col("model_name").isin(base, tuned))
    return pair.join(common_asins(evaluations, base, tuned), "asin", "left_semi").select(evaluations.columns)


def aligned_scores(evaluations: DataFrame, base: str, tuned: str, *criteria: str) -> DataFrame:
    """One row per asin pair with ``base_`` and ``tuned_`` scores side by side."""

    def side(model: str, name: str) -> DataFrame:
        rows = evaluations.filter(F.col("model_name") == model)
        return rows.select("asin", *(F.col(c).alias(f"{name}_{c}") for c in criteria))

    return side(base, "base").join(side(tuned, "tuned"), "asin")


def with_listing(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``rows`` (asin, parent_asin, ...) with their product: that of parent_asin = asin, else that of the parent.

    A repeated product counts once. Two joins on the small side of one row per asin, so that ``rows`` is computed once.
    """
    products = unique_products(products)
    fields = ["title", "description", "features", "price"]
    listing = F.struct(*(F.col(f).alias(f"product_{f}") for f in fields))
    own = products.select(F.col("parent_asin").alias("asin"), listing.alias("_own"))
    parents = products.select("parent_asin", listing.alias("_parents"))
    found = rows.join(own, "asin", "left").join(parents, "parent_asin", "left")
    product = F.coalesce("_own", "_parents")
    return found.select(*rows.columns, product.isNotNull().alias("has_product"), product.alias("_product")).select(
        *rows.columns, "has_product", "_product.*"
    )


def review_parents(reviews: DataFrame) -> DataFrame:
    """One row per asin with the smallest parent_asin among its reviews."""
    return reviews.filter(F.col("asin").isNotNull()).groupBy("asin").agg(F.min("parent_asin").alias("parent_asin"))
