"""Reading and normalising reviews, products, labels and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill import schemas
from reviewmill.functions import selection

# Nested columns of raw product metadata.
NESTED_PRODUCT_COLUMNS = ["images", "videos", "bought_together", "subtitle", "author"]
LAST_MILLIS = 9_223_372_036_854  # of a timestamp with 64 bits of nanoseconds


def read_raw_reviews(
    spark: SparkSession, path: str, sample_size: int | None = None, file_format: str = "parquet"
) -> DataFrame:
    """Raw reviews with the declared schema; all rows, or a repeatable sample of ``sample_size``."""
    raw = spark.read.schema(schemas.RAW_REVIEW).format(file_format).load(path)
    return cap_rows(raw, sample_size, "user_id", "asin", "timestamp", "title")


def cap_rows(df: DataFrame, n: int | None, *columns: str) -> DataFrame:
    """At most ``n`` rows, the same ones on every run, chosen by a hash of ``columns``."""
    return df if n is None else selection.top_rows(
        df, n, selection.hash_key(*map(F.col, columns), seed=0), bounds=selection.HASH_BOUNDS
    )


def epoch_millis(value: Column) -> Column:
    """Epoch milliseconds to timestamp; anything that is not a number, or outside the years 1677 to 2262, becomes null."""
    millis = value.try_cast("bigint")
    return F.timestamp_millis(F.when(millis.between(-LAST_MILLIS, LAST_MILLIS), millis))


def normalise_reviews(raw: DataFrame) -> DataFrame:
    """``helpful_vote`` renamed, epoch milliseconds parsed, the eight review columns kept."""
    if "helpful_vote" in raw.columns:
        raw = raw.withColumnRenamed("helpful_vote", "helpful_votes")
    if "timestamp" in raw.columns and not isinstance(raw.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raw = raw.withColumn("timestamp", epoch_millis(F.col("timestamp")))
    return schemas.conform(raw, schemas.REVIEW)


def read_raw_products(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Raw product metadata; nested columns that no result needs are never read."""
    return spark.read.schema(schemas.RAW_PRODUCT).format(file_format).load(path)


def drop_nested(raw: DataFrame) -> DataFrame:
    return raw.drop(*NESTED_PRODUCT_COLUMNS)


def normalise_products(raw: DataFrame) -> DataFrame:
    """Category renamed, lists joined by "; ", one row per parent_asin over the whole table.

    Where a parent_asin repeats, the row with the most ratings stays, then the smallest title.
    """
    if "main_category" in raw.columns:
        raw = raw.withColumnRenamed("main_category", "category")
    for name in ("description", "features"):
        if name in raw.columns and isinstance(raw.schema[name].dataType, T.ArrayType):
            raw = raw.withColumn(name, F.array_join(name, "; "))
    return unique_products(schemas.conform(raw, schemas.PRODUCT))


def unique_products(products: DataFrame) -> DataFrame:
    """One row per parent_asin, most ratings first. The smallest of each map task travels, so repeated keys do not pile up."""
    rest = [c for c in products.columns if c != "parent_asin"]
    order = (F.coalesce(-F.col("rating_number"), F.lit(1)) if "rating_number" in rest else F.lit(0)).alias("_votes")
    best = products.groupBy("parent_asin").agg(F.min(F.struct(order, *rest)).alias("best"))
    return best.select("parent_asin", *(F.col(f"best.{c}").alias(c) for c in rest)).select(products.columns)


def latest_reviews(reviews: DataFrame, n: int, id_column: str = "id") -> DataFrame:
    """The ``n`` newest reviews (null timestamps last, ties by id), found without a global sort."""
    newest = selection.descending(selection.micros(F.col("timestamp")))

    def prune(cut: int) -> Column:
        return F.col("timestamp") >= F.timestamp_micros(F.lit(-cut)) if cut < selection.LAST else F.lit(True)

    return selection.top_rows(reviews, n, newest, F.col(id_column), prune=prune)


def scan(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Only the named columns of a parquet table; the filter reaches the scan."""
    df = spark.read.parquet(path)
    return (df if where is None else df.filter(where)).select(*columns)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled reviews from CSV; texts may hold quotes and line breaks.

    Nothing between commas is null, a quoted nothing is an empty text; the null marker only keeps the two apart.
    """
    return spark.read.csv(
        path, schema=schemas.LABELLED_REVIEW, header=True, multiLine=True, escape='"', nullValue="\u0000"
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Prompt and summary pairs from JSON lines."""
    return spark.read.schema(schemas.PAIR).json(path)
