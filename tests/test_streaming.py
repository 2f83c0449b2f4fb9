import datetime

import pytest
from pyspark.sql import functions as F

from reviewmill import schemas
from reviewmill.operators import product_features
from reviewmill.session import forget, new_path
from reviewmill.sources import readers
from reviewmill.streaming import ingest


def raw(spark, first, last):
    df = spark.range(first, last).select(
        F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("asin"),
        (F.col("id") % 5 + 1).cast("double").alias("rating"),
        F.lit("battery died").alias("text"),
        F.when(F.col("id") % 7 != 0, (F.lit(1_700_000_000_000) + F.col("id") * 7_200_000).cast("string")).otherwise("bad").alias("timestamp"),
    )
    return schemas.conform(df, schemas.RAW_REVIEW)


def test_ingest_goes_on_where_it_stopped(spark):
    source, target, checkpoint = (new_path(spark, f"stream-{n}") for n in ("source", "target", "checkpoint"))
    for first, last, total in ((0, 50, 50), (50, 80, 80), (80, 80, 80)):
        raw(spark, first, last).write.mode("append").parquet(source)
        ingest.ingest(ingest.stream_raw_reviews(spark, source), target, checkpoint).awaitTermination()
        assert spark.read.parquet(target).count() == total
    stored = spark.read.parquet(target)
    assert stored.filter("timestamp IS NULL").count() == 12
    assert stored.select("id").filter("id IS NOT NULL").distinct().count() == 80


def test_no_row_is_too_late(spark):
    source, target = new_path(spark, "late-source"), new_path(spark, "late-counts")
    for millis in ("1700000000000", "1500000000000", "1500000000000"):
        rows = spark.createDataFrame([("a", 1.0, millis)], "asin string, rating double, timestamp string")
        schemas.conform(rows, schemas.RAW_REVIEW).write.mode("append").parquet(source)
        stream = readers.normalise_reviews(ingest.stream_raw_reviews(spark, source))
        ingest.write_daily_counts(stream, target, target + "-cp").awaitTermination()
    assert sorted(r["review_count"] for r in ingest.summed_counts(spark, target).collect()) == [1, 2]


def test_stream_counts_equal_batch_features(spark):
    source, reviews, target = (new_path(spark, f"counts-{n}") for n in ("source", "reviews", "target"))
    for first in (0, 40):
        raw(spark, first, first + 40).write.mode("append").parquet(source)
        ingest.ingest(ingest.stream_raw_reviews(spark, source), reviews, reviews + "-cp").awaitTermination()
        stream = spark.readStream.schema(schemas.REVIEW).parquet(reviews)
        ingest.write_daily_counts(stream, target, target + "-cp").awaitTermination()
    got = {(r["asin"], r["date"]): (r["rating_sum"], r["review_count"], r["negative_count"]) for r in ingest.summed_counts(spark, target).collect()}
    daily = product_features.daily_features(spark.read.parquet(reviews)).collect()
    want = {(r["asin"], r["date"]): (r["rating_avg"] * r["review_count"], r["review_count"], r["negative_count"]) for r in daily}
    assert got == want and len(got) > 10


def sums_of(spark, rows):
    columns = "asin string, date date, rating_sum double, review_count long, negative_count long"
    return spark.createDataFrame([(a, datetime.date(2024, 1, d), s, n, n // 2) for a, d, s, n in rows], columns)


def test_batches_merge_in_levels(spark):
    target, wanted = new_path(spark, "levels"), {}
    for batch in range(30):
        rows = [("a", 1 + batch % 3, 1.5, batch), (f"p{batch % 4}", 2, 2.0, 1)]
        for asin, day, total, n in rows:
            old = wanted.get((asin, day), (0, 0, 0))
            wanted[asin, day] = (old[0] + total, old[1] + n, old[2] + n // 2)
        ingest.add_sums(sums_of(spark, rows), batch, target, fan=3)
        if batch in (2, 8, 13, 29):
            got = {(r["asin"], r["date"].day): tuple(r)[2:] for r in ingest.summed_counts(spark, target).collect()}
            assert got == wanted
            ingest.add_sums(sums_of(spark, rows), batch, target, fan=3)  # replayed
            assert {(r["asin"], r["date"].day): tuple(r)[2:] for r in ingest.summed_counts(spark, target).collect()} == wanted
    version, entries = ingest.read_manifest(spark, target)
    assert version == 29 and [level for level, _ in entries] == [3, 1]  # 30 batches are 27 + 3
    assert len(ingest.names_below(spark, f"{target}/manifests")) <= 2
    assert len(ingest.names_below(spark, f"{target}/sums")) <= 6


def test_an_unfinished_manifest_does_not_count(spark):
    target = new_path(spark, "torn")
    assert ingest.summed_counts(spark, target).collect() == []
    ingest.add_sums(sums_of(spark, [("a", 1, 1.0, 1)]), 0, target)
    spark.createDataFrame([(0, 0, "gone")], "place int, level int, folder string").write.json(f"{target}/manifests/1")
    forget(spark, f"{target}/manifests/1/_SUCCESS")
    assert [r["review_count"] for r in ingest.summed_counts(spark, target).collect()] == [1]
    ingest.add_sums(sums_of(spark, [("a", 1, 1.0, 4)]), 1, target)
    assert [r["review_count"] for r in ingest.summed_counts(spark, target).collect()] == [5]


def test_ids_do_not_read_other_batches(spark):
    rows = spark.range(100).repartition(7).select(F.lit("a").alias("asin"))
    ids = [sorted(r["id"] for r in ingest.with_batch_ids(rows, batch).collect()) for batch in (0, 1, 5)]
    assert [len(set(i)) for i in ids] == [100] * 3 and ids[0][-1] < ids[1][0] and ids[1][-1] < ids[2][0]
    with pytest.raises(ValueError):
        ingest.with_batch_ids(rows, 1 << ingest.BATCH_BITS)
