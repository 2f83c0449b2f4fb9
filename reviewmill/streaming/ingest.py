"""Micro-batch ingest of raw reviews and incremental daily counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewmill import schemas
from reviewmill.session import forget
from reviewmill.sources.readers import normalise_reviews

BATCH_BITS, TASK_BITS, ROW_BITS = 21, 18, 24
FAN = 8  # folders of a level before they become one of the next


def stream_raw_reviews(
    spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_REVIEW, files_per_batch: int = 1000
) -> DataFrame:
    """New parquet files below ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(raw: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Normalise whatever is new and append it to ``target`` exactly once with unique ids, then stop.

    The checkpoint replaces the "skip if the table holds rows" guard: a restart goes on after the last finished batch. A
    batch is a folder ``batch=<n>``, which a replayed batch replaces. Ids are made of the batch, the task and the row's place
    in it, so no batch reads another; those of a batch are above those of all batches before.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        with_batch_ids(batch, batch_id).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _run(normalise_reviews(raw), checkpoint, save)


def with_batch_ids(rows: DataFrame, batch_id: int) -> DataFrame:
    """``rows`` with a unique ``id``: bits for the batch, the task and the row. A number that does not fit is an error."""
    if batch_id >= 1 << BATCH_BITS:
        raise ValueError(f"batch {batch_id} has more than {BATCH_BITS} bits")
    place = F.monotonically_increasing_id()  # 33 bits for the row, the ones above for the task
    task, row = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (task < (1 << TASK_BITS)) & (row < (1 << ROW_BITS))
    number = F.shiftleft(F.lit(batch_id).cast("long"), TASK_BITS + ROW_BITS) + F.shiftleft(task, ROW_BITS) + row
    return rows.select(F.when(fits, number).otherwise(F.raise_error(F.lit("too many rows or tasks in a batch")).cast("long")).alias("id"), "*")


def daily_counts(reviews: DataFrame) -> DataFrame:
    """Sums per (asin, day)."""
    rows = reviews.filter(F.col("asin").isNotNull() & F.col("timestamp").isNotNull())
    return rows.groupBy("asin", F.to_date("timestamp").alias("date")).agg(
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("review_count"),
        F.count_if(F.col("rating") <= 2).alias("negative_count"),
    )


def write_daily_counts(reviews: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Add each batch's own sums to the levels below ``target``.

    All measures add up, so there is neither state nor a watermark, and no row is too late to count.
    """
    return _run(reviews, checkpoint, lambda batch, batch_id: add_sums(daily_counts(batch), batch_id, target))


def add_sums(sums: DataFrame, batch_id: int, target: str, fan: int = FAN) -> None:
    """Put the sums of a batch below ``target`` and name what is valid there in a manifest, once per batch.

    Folders have levels. As soon as ``fan`` folders of a level are there, they are summed into one of the next level, so after
    n batches fewer than ``fan`` times log(n) to the base ``fan`` folders are left, and a row is rewritten as often as
    there are levels. A manifest is valid when its write is complete; until then readers use the one before, and a batch that
    has one is not added again. Folders that the last two manifests do not name are deleted.
    """
    spark = sums.sparkSession
    last, entries = read_manifest(spark, target)
    if last >= batch_id:
        return
    before = [folder for _, folder in entries]
    entries = [*entries, (0, _store(sums, target, 0))]
    while len(entries) >= fan and len({level for level, _ in entries[-fan:]}) == 1:
        level = entries[-1][0] + 1
        merged = spark.read.schema(sums.schema).parquet(*(f"{target}/sums/{f}" for _, f in entries[-fan:]))
        entries = [*entries[:-fan], (level, _store(_added(merged), target, level))]
    manifest = spark.createDataFrame(list(enumerate(entries)), "place int, entry struct<level: int, folder: string>")
    manifest.coalesce(1).select("place", "entry.*").write.mode("overwrite").json(f"{target}/manifests/{batch_id}")
    valid = {*before, *(folder for _, folder in entries)}
    forget(spark, *(f"{target}/sums/{f}" for f in names_below(spark, f"{target}/sums") if f not in valid))
    versions = sorted(map(int, names_below(spark, f"{target}/manifests")))
    forget(spark, *(f"{target}/manifests/{v}" for v in versions if v < last))


def _store(sums: DataFrame, target: str, level: int) -> str:
    """Writes to a folder of its own, whose name is returned; AQE sizes the files."""
    folder = f"level-{level}-{uuid.uuid4().hex}"
    sums.hint("rebalance").write.parquet(f"{target}/sums/{folder}")
    return folder


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []


def read_manifest(spark: SparkSession, target: str) -> tuple[int, list[tuple[int, str]]]:
    """The number of the newest complete manifest (-1 for none) and its (level, folder), oldest batches first."""
    for version in sorted(map(int, names_below(spark, f"{target}/manifests")), reverse=True):
        if "_SUCCESS" in names_below(spark, f"{target}/manifests/{version}"):
            rows = spark.read.schema("place int, level int, folder string").json(f"{target}/manifests/{version}").collect()
            return version, [(row["level"], row["folder"]) for row in sorted(rows)]
    return -1, []


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("asin", "date").agg(*(F.sum(c).alias(c) for c in ("rating_sum", "review_count", "negative_count")))


def _run(rows: DataFrame, checkpoint: str, save: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )


def summed_counts(spark: SparkSession, target: str) -> DataFrame:
    """Totals per (asin, date) over all batches added so far."""
    _, entries = read_manifest(spark, target)
    schema = "asin string, date date, rating_sum double, review_count long, negative_count long"
    if not entries:
        return spark.createDataFrame([], schema)
    return _added(spark.read.schema(schema).parquet(*(f"{target}/sums/{folder}" for _, folder in entries)))
