"""Importance resampling of documents towards the features of a target table.

Features are runs of one to ``longest`` words, hashed into buckets by the crc32 of their bytes. The distinct features of a
window of words are laid out by length: all of one length form a matrix of bytes, and their checksums are brought forward
together, one column of the matrix at a time. Tasks return counts per bucket only, so what reaches the driver has as many
rows as there are buckets, whatever the corpus holds. A second pass looks up the gain of every feature's bucket.

Scores get Gumbel noise from a hash of the id, so the highest ones are a sample without replacement. Ranks come from range
partitions of the scores and the sizes of the partitions before; no task sees more than its range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.texts import MULTIPLIER, flat, lower_table, mixed
from reviewmill.session import new_path, settle_at

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
WINDOW_WORDS = 1 << 17
LONG_FEATURE = 512  # longer features are rare; a column each would cost more than a checksum of their own


def word_kinds() -> np.ndarray:
    """True for bytes of words: digits, letters and all bytes from 0x80."""
    return np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def crc_table() -> np.ndarray:
    """The table of crc32, by its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def matrix_crcs(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """crc32 of every row of a matrix of bytes, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = table[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of bytes, and for each row the number of its distinct one."""
    width = max(8, -(-rows.shape[1] // 8) * 8)
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    parts = wide.view(np.uint64)
    place = parts[:, 0].copy()
    for part in parts.T[1:]:
        place = mixed(place * np.uint64(MULTIPLIER) + part)
    order = np.argsort(place)  # equal rows meet; should others share their place, a row may only be listed twice
    fresh = np.concatenate([[True], np.zeros(len(rows) - 1, bool)])
    for part in parts.T:
        ordered = part[order]
        fresh[1:] |= ordered[1:] != ordered[:-1]
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return rows[order[fresh]], number


class Buckets:
    """Buckets of the features of texts; one object per task."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest = buckets, longest
        self.table, self.kinds, self.lower = crc_table(), word_kinds(), lower_table()

    def crcs(self, line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """crc32 of the slices of ``line``."""
        found, sizes = np.empty(len(starts), np.uint32), ends - starts
        by_size = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[by_size], prepend=-1))
        for group in np.split(by_size, cuts[1:]):
            size = int(sizes[group[0]]) if len(group) else 0
            if size > LONG_FEATURE:
                found[group] = [zlib.crc32(line[s : s + size]) for s in starts[group].tolist()]
            elif len(group):
                features, number = distinct_rows(line[starts[group][:, None] + np.arange(size)])
                found[group] = matrix_crcs(features, self.table)[number]
        return found

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each row the number of its first word (n + 1 values)."""
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.kinds[data]
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        cut = offsets[1:-1]  # a word that runs over the end of a row is two
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[inside[cut] & inside[cut + 1]]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        return starts, ends, np.searchsorted(starts, offsets)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, bucket) of all features, in windows of words, and the number of words of every row, with the first one."""
        starts, ends, first = self.words(data, offsets)
        of, sizes = np.repeat(np.arange(len(offsets) - 1), np.diff(first)), np.diff(first)
        if not len(starts):
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
        for low in range(0, len(starts), WINDOW_WORDS):
            high = min(low + WINDOW_WORDS, len(starts))
            far = min(high + self.longest - 1, len(starts))
            length = ends[low:far] - starts[low:far]
            places = np.concatenate([[0], np.cumsum(length + 1)])  # the words of the window with one space after each
            line = np.full(places[-1], 32, np.uint8)
            inner = np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)
            source = np.repeat(starts[low:far] - (places[:-1] - np.arange(len(length))), length) + np.arange(length.sum())
            line[inner] = self.lower[data[source]]
            rows, found = [], []
            for n in range(1, self.longest + 1):
                at = np.arange(0, min(high, len(starts) - n + 1) - low)
                at = at[of[low + at] == of[low + at + n - 1]]
                rows.append(of[low + at])
                found.append(self.crcs(line, places[at], places[at + n] - 1).astype(np.int64) % self.buckets)
            yield np.concatenate(rows), np.concatenate(found), sizes if low == 0 else np.zeros_like(sizes)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket. At most ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, sums = Buckets(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in look(*flat(batch.column(0))):
                sums += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int32()), "n": pa.array(sums[seen])})

    found = texts.select(F.col(text)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    sums = np.zeros(buckets, np.int64)
    for row in found.collect():
        sums[row["bucket"]] = row["n"]
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier each bucket is in the target, smoothed by one, floored."""
    s, t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in pairs], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``key``, n_words, n_features and weight, the floored mean gain of the features (0 without any), for every row."""
    kind = docs.schema[key].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Buckets(len(gain), longest)
        for batch in batches:
            features, sums, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, found, sizes in look(*flat(batch.column(1))):
                features += np.bincount(rows, minlength=batch.num_rows)
                np.add.at(sums, rows, gain[found])
                words += sizes
            mean = np.where(features > 0, sums // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, mean))], ["key", *COLUMNS])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, " + ", ".join(f"{name} long" for name in COLUMNS)
    return rows.mapInArrow(weigh, schema).withColumnRenamed("key", key)


COLUMNS = ("n_words", "n_features", "weight")


def noise(key: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the hash of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``key``, n_words, n_features, weight, score and rank for every row of ``docs``.

    Rows with at least ``least_words`` words can be drawn; the ``percent`` of them with the highest scores are, ranked from
    1, ties to the smaller key, nulls last; rows equal in both in any order. rank is null for all others. A null text has
    no words and weight 0. Rows with equal keys are rows of their own; other columns are not read. Without documents the
    result is empty, without target texts all gains come from the smoothing.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    spark = docs.sparkSession
    scored = weights(docs, gain, key, text, longest).withColumn("score", F.col("weight") + noise(key, seed))
    scored = settle_at(scored.withColumn("row", F.monotonically_increasing_id()), new_path(spark, "scores"))
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("row")]
    ranges = new_path(spark, "ranges")
    parted = scored.filter(able).repartitionByRange(*order).sortWithinPartitions(*order)
    # a partition's rows are numbered in their sorted order by the low bits of this number, its place by the high ones
    placed = settle_at(parted.select("row", F.monotonically_increasing_id().alias("place")), ranges)
    part = F.shiftright("place", 33)
    sizes = sorted((row["part"], row["n"]) for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for number, size in sizes:
        rows.append((number, before))
        before += size
    starts = spark.createDataFrame(rows, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").select("row", rank.alias("rank"))
    found = scored.join(ranked.filter(F.col("rank") <= drawn), "row", "left")
    return found.select(key, *COLUMNS, "score", "rank")
