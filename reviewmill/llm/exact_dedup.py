"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

Digests of all texts are settled once. A Misra-Gries summary (the frequent-items sketch behind ``approx_top_k``) names
digests that may be frequent; their exact counts are taken, and the verified ones, at most ``heavy`` rows, are broadcast,
so their rows are resolved where they are read. All other digests have a bounded share of the rows and are shuffled.
The sketch decides the route only: any answer of it gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.session import settle

HEAVY = 256


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. In each group of equal texts the row with the largest key is kept; null keys come
    last. Of repeated rows with that key exactly one is kept. keep_id is null if all keys of a group are null. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    digests = settle(
        docs.select(
            F.col(key).alias("id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    frequent = frequent_digests(digests, heavy)
    keep = F.max(F.struct("id", "row")).alias("keep")
    size = F.count("*").alias("group_size")
    marked = digests.join(F.broadcast(frequent), "text_sha256", "left")
    heavy_rows = marked.filter(F.col("keep").isNotNull())
    rest = marked.filter(F.col("keep").isNull()).drop("keep", "group_size")
    groups = rest.groupBy("text_sha256").agg(keep, size)
    every = heavy_rows.unionByName(rest.join(groups, "text_sha256"))
    return every.select(
        F.col("id").alias(key), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256",
    )


def frequent_digests(digests: DataFrame, heavy: int) -> DataFrame:
    """Digests that hold at least one row in ``4 * heavy``, with the row to keep and the exact count: at most ``heavy``."""
    spark = digests.sparkSession
    summary = digests.agg(
        F.expr(f"approx_top_k(text_sha256, {heavy}, {32 * heavy})").alias("top"), F.count("*").alias("n")
    ).first()
    names = [(entry["item"],) for entry in summary["top"] or []]
    candidates = spark.createDataFrame(names, "text_sha256 string")
    counted = (
        digests.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size"))
    )
    return counted.filter((F.col("group_size") > 1) & (F.col("group_size") * 4 * heavy >= summary["n"]))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    rows = F.concat_ws("|", F.sha2(F.coalesce(text, F.lit("")), 256), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    found = exact_duplicates(docs, key, text, heavy).filter("kept")
    kept = found.select(F.concat_ws("|", "text_sha256", F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("_row"))
    return docs.withColumn("_row", rows).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)
