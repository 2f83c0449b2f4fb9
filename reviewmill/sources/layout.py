"""Reviews laid out by product, so that work by product needs no shuffle.

Products of ordinary size are stored in buckets by asin, sorted by time. A bucket is read by one task, so products that would
fill a large part of one are stored apart and go the usual way with partial sums and split partitions. Texts are not shuffled
to be stored: every task writes its own rows, a sorted file per bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.session import scratch, settle

HOT_SHARE = 4  # a product is hot if it has more than a fourth of an average bucket


@dataclass
class ReviewLayout:
    """The bucketed rows, and those of hot products and without one. Every product is in one of them."""

    bucketed: DataFrame
    apart: DataFrame

    @property
    def reviews(self) -> DataFrame:
        return self.bucketed.unionByName(self.apart)

    def by_product(self, operator: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
        """The result of an operator whose rows depend on one product each; it is told whether products are together."""
        return operator(self.bucketed, True).unionByName(operator(self.apart, False))


def write_layout(reviews: DataFrame, table: str, path: str, buckets: int) -> ReviewLayout:
    """Store ``reviews`` as ``table`` below ``path`` in ``buckets`` buckets, and as ``table``_apart.

    The hot products are at most ``HOT_SHARE * buckets``, so the list that marks them is small. Existing tables are replaced.
    A bucket has a file for every task with rows of it, so few buckets and large tasks make few files.
    """
    with scratch(reviews.sparkSession):
        sizes = settle(reviews.groupBy("asin").agg(F.count("*").alias("n")), "sizes")
        limit = max(1.0, (sizes.agg(F.sum("n")).first()[0] or 0) / (HOT_SHARE * buckets))
        hot = sizes.filter(F.col("asin").isNotNull() & (F.col("n") > limit)).select("asin", F.lit(True).alias("_hot"))
        marked = reviews.join(F.broadcast(hot), "asin", "left")
        usual = marked.filter(F.col("_hot").isNull() & F.col("asin").isNotNull()).select(reviews.columns)
        apart = marked.filter(F.col("_hot").isNotNull() | F.col("asin").isNull()).select(reviews.columns)
        writer = usual.write.bucketBy(buckets, "asin").sortBy("asin", "timestamp").option("compression", "zstd")
        writer.option("path", f"{path}/bucketed").mode("overwrite").saveAsTable(table)
        writer = apart.write.option("compression", "zstd")
        writer.option("path", f"{path}/apart").mode("overwrite").saveAsTable(f"{table}_apart")
    return read_layout(reviews.sparkSession, table)


def read_layout(spark: SparkSession, table: str) -> ReviewLayout:
    return ReviewLayout(spark.table(table), spark.table(f"{table}_apart"))
