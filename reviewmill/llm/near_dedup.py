"""Near duplicates: Jaccard join of word n-gram sets with Bayesian candidate pruning.

1. Texts with equal n-gram sets form a class; everything else works on one member of each class.
2. A class has ``BANDS * ROWS`` MinHash values of 16 bits. Classes that agree on all values of a band are candidates.
3. In each bucket the values of a pair are compared step by step. With m of n values equal and an even prior, the chance
   that the similarity reaches the threshold is that of at most m successes in n + 1 trials at the threshold; a pair goes
   when it falls below ``TOLERANCE``. A pair is looked at in the first band it shares only.
4. What is left is joined into groups, and in each group the n-gram sets are compared exactly.

Large buckets and large groups are cut into blocks; every two blocks meet in a task of bounded size, which counts links and
joins them into stars, so pairs of a group never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.components import connected_components
from reviewmill.llm.stars import Stars, lowest_ids
from reviewmill.llm.texts import Tokens, flat, grams, mixed, ranges
from reviewmill.session import forget, new_path, settle, settle_at, small_batches

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, TOLERANCE, STEP = 32, 4, 1e-6, 16
BUCKET_ROWS, GROUP_GRAMS, CELLS = 256, 1 << 17, 128
BLOCK_BYTES, CHUNK = 4 << 20, 1 << 15


def word_kinds() -> np.ndarray:
    """Words are runs of ASCII letters and digits and of bytes from 0x80."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    kinds[0x80:] = 1
    return kinds


def least_equal(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values among n with which the chance to reach the threshold is not below ``tolerance``."""
    chance = 0.0
    for m in range(n + 1):
        chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if chance >= tolerance:
            return m
    return n


class GramSets:
    """Sorted distinct hashes of the word n-grams of each text. A text of fewer words has one n-gram of all its words."""

    def __init__(self, words: int):
        self.words, self.tokens = words, Tokens(word_kinds(), lower=True)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        found, rows = self.tokens(data, offsets)
        hashes = grams(found, self.words, self.words)
        for low, high in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if high - low >= self.words:
                yield np.unique(hashes[low : high - self.words + 1])
            elif high > low:
                yield grams(found[low:high], high - low, self.words)
            else:
                yield found[:0]


def class_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    twice = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return int(hashes.sum(dtype=np.uint64).view(np.int64)), int(twice.sum(dtype=np.uint64).view(np.int64))


class MinHash:
    """16-bit values: the low bits of the smallest of a x + b modulo 2^32 over the set, for each (a, b)."""

    def __init__(self, n: int = BANDS * ROWS):
        chosen = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, (2, n), np.uint64).astype(np.uint32)
        self.a, self.b = chosen[0] | np.uint32(1), chosen[1]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for low in range(0, len(x), 2048):
            part = x[low : low + 2048]
            np.minimum(least, (self.a[:, None] * part + self.b[:, None]).min(1), out=least)
        return least.astype(np.uint16)


def describe(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, grams, low, high, values): the size and class of the n-gram set and its MinHash values, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, minhash = GramSets(words), MinHash()
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for first, last in ranges(offsets, BLOCK_BYTES):
                part = offsets[first : last + 1]
                sizes, keys, values = [], [], []
                for hashes in sets(data[part[0] : part[-1]], part - part[0]):
                    sizes.append(len(hashes))
                    keys.append(class_key(hashes))
                    values.append(minhash(hashes).tobytes() if len(hashes) else None)
                low, high = zip(*keys)
                columns = [batch.column(0).slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(low, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(high, pa.int64()), pa.array(values, pa.binary())], ["id", "grams", "low", "high", "values"]
                )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    return rows.mapInArrow(run, "id long, grams long, low long, high long, values binary")


def candidate_links(members: DataFrame, threshold: float, tolerance: float, bucket_rows: int) -> DataFrame:
    """(id, root): stars of the pairs that share a bucket and survive the pruning, from rows (id, values).

    The root is the smallest id of a star, so the stars of many buckets agree.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)
            keys = mixed(mixed(values) + salt).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))],
                ["id", "keys"],
            )

    keyed = members.select("id", "values").mapInArrow(bands, "id long, keys array<long>")
    placed = keyed.select("id", F.posexplode("keys").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    rows = placed.join(shared.withColumn("blocks", F.ceil(F.col("n") / bucket_rows).cast("int")).drop("n"), "bucket")
    block = F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int")
    meetings = (
        rows.join(members.select("id", "values"), "id").withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    )
    cells = meetings.groupBy("bucket", "band", "first", "second").agg(
        F.collect_list(F.struct("id", "block", "values")).alias("rows")
    ).filter((F.size("rows") > 1)).select("band", F.col("first") != F.col("second"), "rows")
    least = np.array([least_equal(n, threshold, tolerance) for n in range(STEP, BANDS * ROWS + 1, STEP)])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for band, across, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                fields = cell.values
                ids = fields.field("id").to_numpy(zero_copy_only=False)
                block = fields.field("block").to_numpy(zero_copy_only=False)
                values = np.frombuffer(b"".join(fields.field("values").to_pylist()), np.uint16).reshape(len(ids), -1)
                root = survivors(band, block if across else None, values, least)
                lowest = lowest_ids(ids, root)
                some = lowest != ids
                found.append((ids[some], lowest[some]))
            if not found:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "root"])

    return cells.mapInArrow(prune, "id long, root long").distinct()


def survivors(band: int, block: np.ndarray | None, values: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The star of each row of a cell. With ``block`` only rows of different blocks are compared."""
    stars, keys = Stars(len(values)), values.view(np.uint64)
    order = np.arange(len(values)) if block is None else np.argsort(block, kind="stable")
    cut = len(values) if block is None else int((block == block.min()).sum())
    for at in range(len(values) if block is None else cut):
        i = order[at]
        others = order[at + 1 :] if block is None else order[cut:]
        if band:
            others = others[~(keys[others, :band] == keys[i, :band]).any(1)]
        equal, n = np.zeros(len(others), np.int64), 0
        for limit in least:
            equal += (values[others, n : n + STEP] == values[i, n : n + STEP]).sum(1)
            n += STEP
            stay = equal >= limit
            others, equal = others[stay], equal[stay]
            if not len(others):
                break
        stars.link(np.full(len(others), i), others)
    return stars.root


def verified_links(docs: DataFrame, key: str, text: str, members: DataFrame, words: int, threshold: float, group_grams: int) -> DataFrame:
    """(id, links, root) of the pairs in a group whose sets really reach the threshold; partial counts and stars.

    ``members``: (id, component, size, grams). Their sets are worked out again from their texts, which are joined by id.
    A group of more than ``group_grams`` n-grams is cut into blocks by the size of the sets: sets of one class of sizes meet,
    and those of neighbouring classes; others differ too much in size to reach the threshold.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = GramSets(words)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for first, last in ranges(offsets, BLOCK_BYTES):
                part = offsets[first : last + 1]
                ids = batch.column(0).slice(first, last - first)
                found = [x.tobytes() for x in sets(data[part[0] : part[-1]], part - part[0])]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], ["id", "set"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    sets = rows.join(members.select("id"), "id", "left_semi").select("id", "text").mapInArrow(sets_of, "id long, set binary")
    totals = members.groupBy("component").agg((F.sum("grams") > group_grams).alias("large"))
    # sets with sizes a <= b reach the threshold only if a >= threshold * b, so their classes differ by one at most
    kind = F.floor(F.log(F.col("grams")) / math.log((1 + 1e-9) / threshold)).cast("int")
    kinds = members.join(totals, "component").withColumn("kind", F.when(F.col("large"), kind).otherwise(0))
    blocks = kinds.groupBy("component", "kind").agg(F.ceil(F.sum("grams") / group_grams).cast("int").alias("blocks"))
    above = blocks.select("component", (F.col("kind") - 1).alias("kind"), F.col("blocks").alias("above"))
    below = blocks.select("component", (F.col("kind") + 1).alias("kind"), F.col("blocks").alias("below"))
    grouped = kinds.join(blocks, ["component", "kind"]).join(above, ["component", "kind"], "left").join(below, ["component", "kind"], "left")
    own = F.col("block")
    place = lambda kind, block: F.struct(kind.alias("kind"), block.alias("block"))
    every = lambda count: F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda first, second: F.struct(first.alias("first"), second.alias("second"))
    k = F.col("kind")
    cells = F.concat(
        F.transform(every("blocks"), lambda o: cell(place(k, F.least(own, o)), place(k, F.greatest(own, o)))),
        F.transform(every("above"), lambda o: cell(place(k, own), place(k + 1, o))),
        F.transform(every("below"), lambda o: cell(place(k - 1, o), place(k, own))),
    )
    meetings = (
        sets.join(grouped, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("cell", F.explode(cells))
        .select("component", "cell.first", "cell.second", "id", F.struct("kind", "block").eqNullSafe(F.col("cell.first")).cast("int").alias("block"), "size", "set")
    )
    cells = meetings.groupBy("component", "first", "second").agg(
        F.collect_list(F.struct("id", "block", "size", "set")).alias("rows")
    ).filter(F.size("rows") > 1).select(F.col("first") != F.col("second"), "rows")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for across, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                fields = cell.values
                ids, block, size = (fields.field(n).to_numpy(zero_copy_only=False) for n in ("id", "block", "size"))
                ids, first = np.unique(ids, return_index=True)  # repeated rows
                block, size, sets = block[first], size[first], fields.field("set")
                sets = [np.frombuffer(sets[i].as_py(), np.uint64) for i in first.tolist()]
                links, root = exact_links(sets, size, block if across else None, threshold)
                some = links > 0
                found.append((ids[some], links[some], lowest_ids(ids, root)[some]))
            if not found:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "links", "root"])

    return cells.mapInArrow(verify, "id long, links long, root long")


def exact_links(sets: list[np.ndarray], size: np.ndarray, block: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked documents and the star of each set in a cell, by the postings of the hashes they share."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(number, kind="stable")
    posting, starts = owner[order], np.cumsum(counts) - counts
    ends, at = np.cumsum(lengths), 0
    links, stars = np.zeros(len(sets), np.int64), Stars(len(sets))
    for i in range(len(sets)):
        own = number[at : ends[i]]
        at = ends[i]
        own = own[counts[own] > 1]
        common = np.zeros(len(sets), np.int64)
        for low in range(0, len(own), CHUNK):
            part = own[low : low + CHUNK]
            n = counts[part]
            places = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common += np.bincount(posting[places], minlength=len(sets))
        # as whole numbers: common / (a + b - common) >= threshold, with the quotient in double precision
        near = (common > 0) & (common / (lengths + lengths[i] - common) >= threshold)
        near[: i + 1] = False
        if block is not None:
            near &= block != block[i]
        others = np.flatnonzero(near)
        if len(others):
            links[i] += size[others].sum()
            links[others] += size[i]
            stars.link(np.full(len(others), i), others)
    return links, stars.root


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE, bucket_rows: int = BUCKET_ROWS, group_grams: int = GROUP_GRAMS,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, class_id, n_links, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of word n-grams is at least ``threshold``. class_id is the
    smallest key with the same set, n_links the number of other documents linked directly, component_id the smallest
    key that links reach. A key stands for one text: of rows with equal keys and different texts each set is compared, and all
    those rows get one result. A text of fewer than ``words`` words has one n-gram of all its words; a null text or one without
    words links with nothing and is a class of its own. Rows without a key link with nothing, have null ids and are kept.
    Rows that repeat key and text count as one document. Other columns are not read.
    """
    described = settle(describe(docs, key, text, words).dropDuplicates(["id", "low", "high"]), "described")
    full = described.filter("grams > 0")
    classes = settle(
        full.groupBy("low", "high").agg(
            F.min("id").alias("id"), F.count("*").alias("size"), F.min("grams").alias("grams"), F.min("values").alias("values")
        ),
        "classes",
    )
    spark, used = docs.sparkSession, [new_path(docs.sparkSession, name) for name in ("candidates", "members")]
    with small_batches(spark, CELLS):
        candidates = settle_at(candidate_links(classes, threshold, tolerance, bucket_rows), used[0])
    linked = connected_components(candidates, "id", "root")
    members = settle_at(classes.select("id", "size", "grams").join(linked, "id"), used[1])
    with small_batches(spark, CELLS):
        links = settle(verified_links(docs, key, text, members, words, threshold, group_grams), "links")
    forget(spark, *used)
    totals = links.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(links, "id", "root")
    by_class = classes.select("low", "high", "id", "size").join(totals, "id", "left").join(groups, "id", "left").select(
        "low", "high", F.col("id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    known = full.select("id", "low", "high").join(by_class, ["low", "high"]).drop("low", "high").dropDuplicates(["id"])
    rows = docs.select(F.col(key).alias(key), F.col(key).cast("long").alias("id")).join(known, "id", "left")
    return rows.select(
        key, F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, of which each group of linked documents has one: that with its smallest key.

    Null texts, texts without words and rows without a key are linked with nothing and stay; an empty table stays empty. A
    key must not stand on different texts (exact copies have one id left): all rows of a key stay or go together.
    """
    dropped = near_duplicates(docs, key, text, words, threshold).filter(~F.col("kept")).select(key).distinct()
    return docs.join(dropped, key, "left_anti").select(docs.columns)
