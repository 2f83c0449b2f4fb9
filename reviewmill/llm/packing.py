"""Best-fit packing by minimum bin slack.

Only the counts of the lengths matter for which lengths share a bin, and there are at most ``capacity`` lengths. So the
plan is made from the histogram: take the longest length left, and by a subset-sum over the lengths still there (a bitset of
reachable sums) find the combination that fills its bin best; use it as often as its lengths last, remove them, repeat.
Each step uses up a length, so there are at most ``capacity`` steps. The pieces are then numbered within their length, in
slices, so a frequent length never meets in one task, and looked up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.tokens import ByteLevel
from reviewmill.session import settle

CAPACITY, SLICE_ROWS, LEAST_SLICES = 2048, 50_000, 64
PIECES = "piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how often, with the largest sum up to ``room``; among equal sums longer lengths first.

    Bit s of ``reach`` says that s is a sum. One step adds one more copy of a length; the search ends when ``room`` is
    reached exactly.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = reach | (reach << length) & full
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + 1
            left -= length
    return sorted(chosen.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, copies, bin, offset): pieces first..last of that length, counted from 0, fill the bins
    from ``bin`` on, ``copies`` in each, the first copy at ``offset``."""
    counts, used, rows, first_bin = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = fullest({x: n for x, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        chosen = dict(rest)
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(counts[x] // n for x, n in chosen.items())
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + bins * copies - 1, copies, first_bin, offset))
            offset += length * copies
            used[length] += bins * copies
            counts[length] -= bins * copies
            if not counts[length]:
                del counts[length]
        first_bin += bins
    return rows


def cut(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Token pieces: ``key``, piece, start, length, ids_crc32. A document's ids end with id 0; a null text is empty.

    A document of more than ``capacity`` ids is cut into pieces of that length; its first piece may be shorter.
    """
    kind = docs.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteLevel(tokenizer)
        for batch in batches:
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                at = 0
                for j in range(-(-len(ids) // capacity)):
                    size = (len(ids) - 1) % capacity + 1 if j == 0 else capacity
                    row.append(i), number.append(j), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size].tobytes()))
                    at += size
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(pieces, f"key {kind}, {PIECES}").withColumnRenamed("key", key)


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``pieces`` (lengths 1..capacity) with sequence_id and offset. Repeated rows are packed as often as they occur."""
    stored = settle(pieces, "pieces")
    total = stored.count()
    slices = max(LEAST_SLICES, -(-total // slice_rows))
    order = [F.col(key), F.col("piece"), F.col("ids_crc32")]
    sliced = stored.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = settle(sliced.groupBy("length", "slice").agg(F.count("*").alias("n")), "lengths")
    histogram = {row["length"]: row["n"] for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spark = pieces.sparkSession
    # at most ``capacity`` steps with at most 63 different lengths each, as 1 + .. + 64 > 2048
    plan = spark.createDataFrame(
        plan_bins(histogram, capacity), "length long, first long, last long, copies long, bin long, at long"
    )
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy(*order)
    ranked = sliced.withColumn("place", F.row_number().over(within) - 1).join(starts, ["length", "slice"])
    ranked = ranked.withColumn("place", F.col("place") + F.col("before"))
    found = ranked.join(F.broadcast(plan), "length").filter(F.col("place").between(F.col("first"), F.col("last")))
    step = F.col("place") - F.col("first")
    return found.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(step / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + F.pmod(step, F.col("copies")) * F.col("length")).alias("offset"),
    )
