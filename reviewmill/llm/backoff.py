"""Stupid-backoff scores of documents under a language model of all other documents.

The steps are relational, on packed rows. Documents are laid down in blocks of a few megabytes. Every block's n-grams are
exploded, aggregated within the block and cut by ranges of their hash, so a frequent n-gram leaves a block once. All parts of
a hash range meet in one task, which sums them: that is the table of n-gram counts, partitioned by hash. Its counts are
joined back to the n-grams of each block, where every document's own occurrences are taken off and its scores are summed.

N-grams are told apart by hashes of 64 bits. Among n different ones about n^2 / 2^65 pairs share a hash: 2^-5 pairs of 2^30
n-grams, 2^7 pairs of 2^36.

Words are runs of anything but ASCII white space, with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.texts import Tokens, flat, grams, numbers_of, whitespace_kinds
from reviewmill.session import new_path, settle_at

ORDER, BACKOFF, BLOCK_BYTES, RANGE_BYTES = 3, 0.4, 4 << 20, 4 << 20


def squeeze(numbers: np.ndarray) -> bytes:
    """Integers, byte by byte of their columns, compressed: high bytes that hardly vary take no room."""
    width = numbers.dtype.itemsize
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def to_block(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def from_block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Grams:
    """The n-grams of a block: their sorted distinct hashes, and for each order the place of the n-gram that ends at a word."""

    def __init__(self, block: bytes, order: int):
        self.rows = from_block(block)
        data, offsets = flat(self.rows.column(1))
        words, starts = Tokens(whitespace_kinds(), lower=True)(data, offsets)
        self.of = numbers_of(starts)
        self.sizes = np.diff(starts)
        self.position = np.arange(len(words)) - starts[:-1][self.of]
        ending = [np.flatnonzero(self.position >= n) for n in range(order)]
        found = np.concatenate([grams(words, n + 1, n + 1)[ends - n] for n, ends in enumerate(ending)])
        by_hash = np.argsort(found)
        found = found[by_hash]
        fresh = np.diff(found, prepend=~found[:1]) != 0
        self.hashes, first = found[fresh], np.flatnonzero(fresh)
        self.counts = np.diff(first, append=len(found))
        inverse = np.empty(len(found), np.int32)
        inverse[by_hash] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.places = []
        for ends in ending:
            place = np.full(len(words), -1, np.int32)
            place[ends], inverse = inverse[: len(ends)], inverse[len(ends) :]
            self.places.append(place)

    def cuts(self, parts: int) -> Iterator[tuple[int, int, int]]:
        """(number, start, end) of each of ``parts`` equal hash ranges that has hashes; ``parts`` is below 2^32."""
        number = (self.hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(number, prepend=number[:1] + np.uint64(1)))
        return zip(number[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(number)])

    def scores(self, totals: np.ndarray, words: int, backoff: float) -> np.ndarray:
        """Log score of each row, with counts over all documents but that row."""
        counts = []
        for place in self.places:
            real = place >= 0
            pair = self.of[real] * (len(self.hashes) + 1) + place[real]
            _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
            left = np.zeros(len(place), np.int64)
            left[real] = totals[place[real]] - own[inverse]
            counts.append(left)
        others = np.maximum(words - self.sizes, 1)[self.of]
        step, log = np.log(backoff), np.log
        score = np.where(counts[0] > 0, log(np.maximum(counts[0], 1) / others), step - log(others))
        for n in range(1, len(counts)):
            context = np.concatenate([[0], counts[n - 1][:-1]]) if len(self.of) else counts[n - 1]
            seen = counts[n] > 0
            longer = np.where(seen, log(np.maximum(counts[n], 1) / np.maximum(context, 1)), step + score)
            score = np.where(self.position >= n, longer, score)
        return np.bincount(self.of, score, len(self.sizes))


def backoff_scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF,
    block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``key``, n_words, log_score (natural), mean_log_score for every row.

    With c counted over all other rows, a word after its context has score c(context word) / c(context) if that n-gram
    occurs, else ``backoff`` times its score after the context without its first word; without context c(word) / N, or
    ``backoff`` / N for a word that no other row has. N is the number of words in the other rows, at least 1. A text
    without words, or null, has log_score 0 and a null mean. Rows with equal keys are rows of their own.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number = f"{TaskContext.get().partitionId()}", 0
        waiting, size = [], 0

        def block():
            nonlocal waiting, size, number
            data = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            found, starts = Tokens(whitespace_kinds()).split(*flat(data.column(1)))[1:]
            waiting, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pydict({"block": [f"{name}-{number}"], "words": [len(found)], "data": [to_block(data)]})

        for batch in batches:
            sizes = np.diff(flat(batch.column(1))[1])
            low = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > block_bytes:
                    if i > low:
                        waiting.append(batch.slice(low, i - low))
                    yield block()
                    low = i
                size += n
            if low < batch.num_rows:
                waiting.append(batch.slice(low))
        if waiting:
            yield block()

    paths = [new_path(spark, name) for name in ("blocks", "counts")]
    blocks = settle_at(rows.mapInArrow(lay, "block string, words long, data binary"), paths[0])
    sums = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    words = blocks.agg(F.sum("words").alias("n")).first()["n"] or 0
    parts = max(1, -(-sums // range_bytes))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Grams(data.as_py(), order)
                gaps = np.diff(found.hashes, prepend=np.uint64(0))
                for part, low, high in found.cuts(parts):
                    hashes = gaps[low:high].copy()
                    hashes[0] = found.hashes[low]
                    counts = found.counts[low:high].astype(np.uint32)
                    yield pa.RecordBatch.from_pydict(
                        {"block": [name], "part": [part], "hashes": [squeeze(hashes)], "counts": [squeeze(counts)]}
                    )

    def total(group: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(unsqueeze(x, np.uint64), dtype=np.uint64) for x in group["hashes"]]
        counts = np.concatenate([unsqueeze(x, np.uint32) for x in group["counts"]]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(inverse, counts).astype(np.int64)[inverse]
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        return pd.DataFrame({"block": group["block"], "part": group["part"], "totals": [squeeze(t) for t in np.split(sums, ends)]})

    exploded = blocks.select("block", "data").mapInArrow(explode, "block string, part long, hashes binary, counts binary")
    counted = exploded.groupBy("part").applyInPandas(total, "block string, part long, totals binary")
    counted = settle_at(counted, paths[1])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = Grams(left["data"].iloc[0], order)
        parts = [unsqueeze(x, np.int64) for x in right.sort_values("part")["totals"]]
        totals = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if len(totals) != len(found.hashes):
            raise ValueError("counts of a block are missing")
        scores = found.scores(totals, words, backoff)
        keys = found.rows.column(0).to_pandas(integer_object_nulls=True)
        return pd.DataFrame({"key": keys, "n_words": found.sizes, "log_score": scores})

    scored = blocks.select("block", "data").groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(
        score, f"key {kind}, n_words long, log_score double"
    )
    result = scored.withColumn("mean_log_score", F.col("log_score") / F.nullif("n_words", F.lit(0)))
    return result.withColumnRenamed("key", key)
