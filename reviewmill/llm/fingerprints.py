"""Document fingerprints by consistent weighted sampling of word pairs.

The terms of a text are its pairs of consecutive tokens (a text of one token has that one), weighted by how often they occur.
Tokens are runs of letters and digits, or of other signs, in lower case. For every term and sample two gamma variates and a
uniform one come from hashes of both, so every text sees the same ones. A sample is the term, with a step of its weight, that
arrives first; two texts share it with a probability that is the sum of the smaller weights over the sum of the larger ones.

Each text is also compared with an edited version, whose end is replaced by the start of the next text, and with the next
text. Texts are range-partitioned by id once; a task walks through its range. The first and the last row of every task are
kept and joined in a second, small job, whose rows are as many as there were tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.texts import MULTIPLIER, Tokens, flat, grams, mixed, numbers_of, run_kinds
from reviewmill.session import new_path, settle_at, small_batches

SAMPLES, PAIR, WINDOW_BYTES, CHUNK, ROWS = 64, 2, 1 << 20, 1 << 14, 512
TINY, SECOND, THIRD = np.float32(1e-9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157)
STEP_FIELDS = ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def log_product(bits: np.ndarray) -> np.ndarray:
    """Of each 64 bits, two uniform numbers between 0 and 1; the negative logarithm of their product."""
    halves = bits.view(np.uint32).reshape(-1, 2)
    first, second = halves[:, 0].astype(np.float32), halves[:, 1].astype(np.float32)
    first += np.float32(0.5)
    second += np.float32(0.5)
    first *= np.float32(2.0**-64)
    first *= second
    np.log(first, out=first)
    np.negative(first, out=first)
    return np.maximum(first, TINY, out=first)


class Sampler:
    """Samples of texts; one object per task."""

    def __init__(self, samples: int = SAMPLES, run: int = PAIR):
        self.samples, self.run, self.tokens = samples, run, Tokens(run_kinds(), lower=True)
        self.seeds = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(MULTIPLIER))

    def terms(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows, hashes and weights of the distinct terms of each text, by row."""
        found = []
        data, offsets = flat(pa.array(texts, pa.large_string()))
        words, first = self.tokens(data, offsets)
        of, sizes = numbers_of(first), np.diff(first)
        for low in range(0, max(len(words), 1), WINDOW_BYTES):
            high = min(len(words), low + WINDOW_BYTES)
            runs = grams(words[low : high + self.run - 1], self.run, 1)
            at = low + np.arange(len(runs))
            same = of[at] == of[at + self.run - 1]
            alone = low + np.flatnonzero(sizes[of[low:high]] < self.run)  # a text shorter than a run: its tokens
            rows = np.concatenate([of[at[same]], of[alone]])
            terms = np.concatenate([runs[same], words[alone]])
            order = np.argsort(terms)
            order = order[np.argsort(rows[order], kind="stable")]
            rows, terms = rows[order], terms[order]
            fresh = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (terms[1:] != terms[:-1])])[: len(rows)])
            found.append((rows[fresh], terms[fresh], np.diff(fresh, append=len(rows))))
        rows, terms, counts = (np.concatenate(part) for part in zip(*found))
        if len(found) > 1:  # parts of a long text meet
            order = np.lexsort((terms, rows))
            rows, terms, counts = rows[order], terms[order], counts[order]
            fresh = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (terms[1:] != terms[:-1])]))
            rows, terms, counts = rows[fresh], terms[fresh], np.add.reduceat(counts, fresh)
        return rows, terms, counts

    def arrivals(self, terms: np.ndarray, log_weights: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """For one sample the logarithm of each term's arrival, and the step of its weight."""
        bits = mixed(terms ^ seed)
        rate = log_product(bits)  # a gamma variate of shape 2, and so is the next one
        second = bits * SECOND
        second ^= second >> np.uint64(32)
        arrival = np.log(log_product(second))
        bits *= THIRD
        bits >>= np.uint64(32)
        shift = bits.astype(np.float32)
        shift *= np.float32(2.0**-32)
        step = log_weights / rate
        step += shift
        np.floor(step, out=step)
        shift -= step
        shift -= np.float32(1)
        rate *= shift
        arrival += rate
        return arrival, step

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of samples, 16 bits each, per text. A text without tokens has zeros only; all others have none."""
        out = np.zeros((len(texts), self.samples), np.uint16)
        rows, terms, counts = self.terms(texts)
        if not len(rows):
            return out
        for low, high in slices(rows):
            self._fill(out, rows[low:high], terms[low:high], counts[low:high])
        return out

    def _fill(self, out: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((counts, terms))  # equal terms of equal weight arrive at once in all texts
        t, c = terms[order], counts[order]
        fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
        number = np.empty(len(terms), np.int64)
        number[order] = np.cumsum(fresh) - 1
        terms, weights = t[fresh], np.log(c[fresh].astype(np.float64)).astype(np.float32)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        places, steps = np.empty(len(terms), np.int64), np.empty(len(terms), np.float32)
        for j, seed in enumerate(self.seeds):
            for low in range(0, len(terms), CHUNK):  # small enough to stay in the processor's cache
                part = slice(low, low + CHUNK)
                arrival, steps[part] = self.arrivals(terms[part], weights[part], seed)
                bits = arrival.view(np.int32)
                ordered = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)  # as integers in the same order
                places[part] = (ordered << 32) | np.arange(low, low + len(bits))
            winner = np.minimum.reduceat(places[number], starts) & 0xFFFFFFFF
            sample = mixed(terms[winner] ^ mixed(seed + steps[winner].astype(np.int64).view(np.uint64)))
            out[rows[starts], j] = (sample >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def slices(rows: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about ``size`` entries, more if one row has more."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    low = 0
    while low < len(rows):
        place = np.searchsorted(starts, low + size, "right") - 1
        high = int(starts[place]) if starts[place] > low else int(starts[place + 1]) if place + 1 < len(starts) else len(rows)
        if low + size >= len(rows):
            high = len(rows)
        yield low, high
        low = high


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points from the start of ``following``, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(texts: list[str], changed: list[str], own: np.ndarray, new: np.ndarray, after: np.ndarray) -> tuple:
    """Columns n_chars ... near_next of texts, their edited versions, and the samples of both and of the next texts."""
    packed = lambda x: pa.array([row.astype(">u2").tobytes() for row in x], pa.binary())
    return (
        [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
        packed(own), packed(new), (own == new).mean(axis=1), (own == after).mean(axis=1),
    )


def walk(batches: Iterator[pa.RecordBatch], sampler: Sampler) -> Iterator[pa.RecordBatch]:
    """Rows in order, each compared with the one after it; the first and the last of the task are returned with their texts."""
    task, key, text, samples = TaskContext.get().partitionId(), None, None, None
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= WINDOW_BYTES):
                size += len(texts[high])
                high += 1
            names, part = keys.slice(low, high - low), texts[low:high]
            if text is None:
                yield edge(task, "first", names.slice(0, 1), part[0])
                before = part[:-1]
            else:
                names, before = pa.concat_arrays([key, names]), [text, *part[:-1]]
            changed = [edited(a, b) for a, b in zip(before, part[len(part) - len(before) :])]
            found = sampler(part + changed)
            own, new = found[: len(part)], found[len(part) :]
            if text is not None:
                own = np.concatenate([samples, own])
            if before:
                yield done(task, names.slice(0, len(before)), compared(before, changed, own[:-1], new, own[1:]))
            key, text, samples, low = names.slice(len(names) - 1), part[-1], own[-1:], high
    if text is not None:
        yield edge(task, "last", key, text)


def edge(task: int, end: str, key: pa.Array, text: str) -> pa.RecordBatch:
    empty = [pa.nulls(1, kind) for kind in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([key, *empty, pa.array([task], pa.int64()), pa.array([end]), pa.array([text])], [*STEP_FIELDS, "task", "edge", "text"])


def done(task: int, keys: pa.Array, columns: tuple) -> pa.RecordBatch:
    none = [pa.array([task] * len(keys), pa.int64()), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.string())]
    return pa.RecordBatch.from_arrays([keys, *map(pa.array, columns), *none], [*STEP_FIELDS, "task", "edge", "text"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, run: int = PAIR) -> DataFrame:
    """``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next row is the one with the next smaller key, nulls last; after the last comes the first again. Rows with equal
    keys follow one another by a hash of their text. A null text counts as empty. Likeness is the share of equal samples:
    texts without tokens are alike (1) and like no other (0). A single row is its own next one. Equal texts have equal
    fingerprints; a sample has 16 bits in the string, so unlike texts share one by chance once in 32,768.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("key"), F.desc("hash")]
    ordered = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("hash")
    plain = f"key {kind}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from walk(batches, Sampler(samples, run))

    path = new_path(spark, "fingerprints")
    with small_batches(spark, ROWS):
        found = settle_at(ordered.mapInArrow(step, f"{plain}, task long, edge string, text string"), path)
    edges = found.filter(F.col("edge").isNotNull())
    tasks = [row["task"] for row in edges.filter(F.col("edge") == "first").select("task").orderBy("task").collect()]
    following = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task long, next long")
    firsts = edges.filter(F.col("edge") == "first").select(F.col("task").alias("next"), F.col("text").alias("after"))
    pairs = edges.filter(F.col("edge") == "last").select("key", "text", "task").join(following, "task").join(firsts, "next")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, run)
        for batch in batches:
            for i in range(batch.num_rows):
                own, after = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                changed = edited(own, after)
                columns = compared([own], [changed], *np.split(sampler([own, changed, after]), 3))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *map(pa.array, columns)], list(STEP_FIELDS))

    inner = found.filter(F.col("edge").isNull()).select(*STEP_FIELDS)
    every = inner.unionByName(pairs.select("key", "text", "after").mapInArrow(meet, plain))
    shown = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return every.withColumns(shown).withColumnRenamed("key", key)
