"""Daily product features: ratings, complaint keywords, entity counts, rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.functions import text as tx

ROLLING_ROWS = 7


def entity_counts(
    reviews: DataFrame, keys: list[str], text: Column, inputs: list[Column], measures: list[Column], scan: bool = True
) -> DataFrame:
    """Counts per (keys, kind, entity), with one extra row per key under kind "review" for the measures.

    Every review is read once and becomes one "review" row and one row per entity it mentions. Map-side combination
    reduces them before the shuffle to at most one row per key and dictionary phrase, however many reviews a product
    has; the shuffle key includes the entity, so a hot product is spread out. ``measures`` aggregate ``inputs`` and
    are read from the "review" rows.
    """
    groups = F.array(
        _group("review", F.array(F.lit(""))),
        _group("component", tx.find_phrases(text, vocab.COMPONENTS, scan)),
        _group("issue", tx.find_phrases(text, vocab.ISSUES, scan)),
    )
    # Texts are read in this projection only; the explodes pass on short values. The first one is an outer explode, as
    # for an inner one Spark adds a filter on the array's size, which would search every text twice.
    read = reviews.select(*keys, *inputs, groups.alias("_groups"))
    names = [c for c in read.columns if c != "_groups"]
    kinds = read.select(*names, F.explode_outer("_groups").alias("_g"))
    mentions = kinds.select(*names, F.col("_g.kind").alias("kind"), F.explode("_g.phrases").alias("entity"))
    return mentions.groupBy(*keys, "kind", "entity").agg(F.count("*").alias("n"), *measures)


def _group(kind: str, phrases: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), phrases.alias("phrases"))


def of_kind(kind: str, value: Column, name: str) -> Column:
    """Aggregate: the value of the single row of a kind."""
    return F.max(F.when(F.col("kind") == kind, value)).alias(name)


def entity_list(kind: str) -> Column:
    """Aggregate: sorted (entity, n) pairs, at most one per dictionary phrase."""
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("entity", "n"))))


def count_map(kind: str) -> Column:
    """Aggregate: map from entity to count, keys in order."""
    return F.map_from_entries(entity_list(kind))


def rating_measures() -> list[Column]:
    return [
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rating_count"),
        F.count_if(F.col("rating") <= 2).alias("negative_count"),
    ]


def daily_features(reviews: DataFrame, entities: bool = True, together: bool = False) -> DataFrame:
    """One row per (asin, date) before the rolling means. Null asins and dates are left out, as in a pandas groupby.

    Without ``entities`` the dictionaries are not searched and the two count maps are missing. ``together`` says that the rows
    of an asin are stored in one bucket, so nothing needs to be shuffled; texts are not scanned then, as Spark does not know rows
    from Python to be partitioned.
    """
    scan = entities and not together
    dated = reviews.withColumn("date", F.to_date("timestamp")).filter("asin IS NOT NULL AND date IS NOT NULL")
    keywords = tx.complaint_score(F.col("text"), scan).alias("keywords")
    measures = [*rating_measures(), F.sum("keywords").alias("keywords")]
    rating_avg = F.try_divide("rating_sum", "rating_count")
    if not entities:
        days = dated.select("asin", "date", "rating", keywords).groupBy("asin", "date").agg(*measures)
        return days.select(
            "asin",
            "date",
            rating_avg.alias("rating_avg"),
            F.col("rating_count").alias("review_count"),
            "negative_count",
            F.col("keywords").alias("complaint_keywords"),
        )
    counts = entity_counts(dated, ["asin", "date"], F.col("text"), [F.col("rating"), keywords], measures, scan)
    # One more shuffle, of reduced rows, serves both the grouping by day and the windows by product.
    return (counts if together else counts.repartition("asin")).groupBy("asin", "date").agg(
        of_kind("review", rating_avg, "rating_avg"),
        of_kind("review", F.col("rating_count"), "review_count"),
        of_kind("review", F.col("negative_count"), "negative_count"),
        of_kind("review", F.col("keywords"), "complaint_keywords"),
        count_map("component").alias("components"),
        count_map("issue").alias("issues"),
    )


def with_rolling_means(daily: DataFrame, rows: int = ROLLING_ROWS) -> DataFrame:
    """Means over the last ``rows`` days that have reviews: review velocity and sentiment."""
    window = Window.partitionBy("asin").orderBy("date").rowsBetween(1 - rows, 0)
    return daily.withColumn("review_velocity", F.avg("review_count").over(window)).withColumn(
        "daily_sentiment_avg", F.avg("rating_avg").over(window)
    )


def product_features(reviews: DataFrame, together: bool = False) -> DataFrame:
    """The feature table, entity counts still as maps."""
    rolled = with_rolling_means(daily_features(reviews, together=together))
    return rolled.select(
        "asin",
        "date",
        "daily_sentiment_avg",
        "review_velocity",
        F.try_divide("negative_count", "review_count").alias("negative_ratio"),
        "complaint_keywords",
        "components",
        "issues",
    )


def with_entity_json(features: DataFrame) -> DataFrame:
    """The two maps as one JSON text column, the stored form."""
    return features.withColumn("ner_entities", F.to_json(F.struct("components", "issues"))).drop("components", "issues")


def merge_counts(left: Column, right: Column) -> Column:
    """Two count maps added key by key."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
