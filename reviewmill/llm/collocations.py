"""Phrases whose words come together more often than chance, by counting in HAT-tries.

Words are counted first. Frequent ones get small numbers by rank; other words break phrases if the ranked ones are all that
can be part of a phrase, else they go by a hash of 63 bits. A task lays the phrases that start at each word (up to the longest
one wanted) into a trie of word numbers: below the first word there are hash containers, and a container that grows too large
bursts into one per next word. When a trie holds too many phrases, its largest subtrees leave as sorted runs, one for each
prefix partition. All runs of a partition meet in one task, are merged, and give the counts of all phrases in it.

The prefix of a phrase ends with its first word that is not among the very frequent ones (two words at least), so no prefix
holds more than about half a partition of phrases before they are counted. Phrases of very frequent words only may be counted
in several partitions, and are summed afterwards.

Words are told apart by 64-bit hashes of language and word: of n different ones about n^2 / 2^65 pairs share a hash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.selection import top_rows
from reviewmill.llm.texts import MULTIPLIER, Tokens, flat, lower_table, mixed, numbers_of, ranges
from reviewmill.session import new_path, settle_at

LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
RANKED, PART_WORDS, TRIE_ENTRIES, BURST, WINDOW_BYTES = 1 << 18, 1 << 20, 1 << 20, 1 << 14, 1 << 21
HASHED = np.uint64(1 << 63)  # sign bit of the number of a word that is known by its hash
SALTS = 64


class Words:
    """Hashes of the words of texts and the pieces they stand in; one object per task."""

    def __init__(self):
        self.lower, kinds = lower_table(), np.full(256, 1, np.uint8)
        kinds[list(b" \t")] = 0
        kinds[list(b".,;:!?\n\v\f\r")] = 0
        self.breaks = np.zeros(256, bool)
        self.breaks[list(b".,;:!?\n\v\f\r")] = True
        self.tokens = Tokens(kinds)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        """Starts and ends of the words, their hashes with the language, the row and the piece they stand in."""
        starts, ends, first = self.tokens.split(data, offsets)
        of = numbers_of(first)
        piece = np.concatenate([[0], np.cumsum(self.breaks[data])])[starts] + of
        hashes = mixed(self.tokens.hashes(data, starts, ends) ^ langs[of])
        return starts, ends, hashes, of, piece


def language_hashes(langs: list[str]) -> np.ndarray:
    """A hash of each language."""
    known = {name: int(pd.util.hash_array(np.array([name], object))[0]) for name in set(langs)}
    return mixed(np.array([known[name] for name in langs], np.uint64) * np.uint64(MULTIPLIER))


def windows_of(batch: pa.RecordBatch, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Lower-case bytes, offsets and languages of rows with about ``WINDOW_BYTES`` together. Longer rows are cut after pieces,
    which no word and no phrase crosses."""
    data, offsets = flat(batch.column(1))
    langs = batch.column(0).to_pylist()
    for low, high in ranges(offsets, WINDOW_BYTES):
        part = words.lower[data[offsets[low] : offsets[high]]]
        if len(part) <= WINDOW_BYTES:
            yield part, offsets[low : high + 1] - offsets[low], langs[low:high]
            continue
        ends = np.append(np.flatnonzero(words.breaks[part]) + 1, len(part))
        ends = ends[np.append(np.diff(ends // WINDOW_BYTES) > 0, True)]  # the last end in each stretch of that size
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield part[start:end], np.array([0, end - start]), langs[low:high]


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, hash and n for all words of (lang, text) rows. Equal words are counted per window before they leave it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for data, offsets, langs in windows_of(batch, words):
                starts, ends, hashes, of, _ = words(data, offsets, language_hashes(langs))
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                sizes = ends[first] - starts[first]
                at = np.concatenate([[0], np.cumsum(sizes)])
                inner = np.arange(at[-1]) + np.repeat(starts[first] - at[:-1], sizes)
                kinds = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[inner]))
                names = pa.array(langs, pa.string()).take(pa.array(of[first]))
                columns = [names, kinds.cast(pa.string()), pa.array(found.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "n"])

    counted = rows.mapInArrow(count, "lang string, word string, hash long, n long")
    return counted.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


class Lexicon:
    """Numbers of words by hash. Words that are not ranked have a negative number, or none if no phrase can hold them."""

    def __init__(self, hashes: np.ndarray, complete: bool):
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.complete = hashes[order], order.astype(np.int64), complete

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words, and which words can be part of a phrase."""
        if not len(self.hashes):
            found = np.zeros(len(hashes), bool)
            numbers = np.zeros(len(hashes), np.int64)
        else:
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found, numbers = self.hashes[place] == hashes, self.numbers[place]
        if self.complete:
            return numbers, found
        return np.where(found, numbers, (hashes | HASHED).view(np.int64)), np.ones(len(hashes), bool)


def phrases_at(numbers: np.ndarray, usable: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """For every word that another one follows, the numbers of the words from there on, plus one, zeros at the end.

    A number below zero stays as it is. A phrase ends with its piece, or before a word that is not usable.
    """
    n = len(numbers)
    shifted = np.where(numbers >= 0, numbers + 1, numbers)
    table = np.zeros((longest, n), np.int64)
    table[0] = np.where(usable, shifted, 0)
    for k in range(1, min(longest, n)):
        same = (piece[k:] == piece[: n - k]) & usable[k:] & (table[k - 1, : n - k] != 0)
        table[k, : n - k] = np.where(same, shifted[k:], 0)
    return np.ascontiguousarray(table[:, table[1] != 0].T)


def distinct(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of numbers in ascending order (unsigned), with the sums of their counts."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    values, local = np.unique(rows.view(np.uint64), return_inverse=True)
    local, bits = local.reshape(rows.shape), max(1, int(len(values) - 1).bit_length())
    per_key = max(1, 63 // bits)
    keys = []
    for low in range(0, rows.shape[1], per_key):
        key = np.zeros(len(rows), np.int64)
        for column in local.T[low : low + per_key]:
            key = (key << bits) | column
        keys.append(key)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    fresh = np.zeros(len(rows), bool)
    fresh[0] = True
    for key in keys:
        ordered = key[order]
        fresh[1:] |= ordered[1:] != ordered[:-1]
    at = np.flatnonzero(fresh)
    sums = np.diff(at, append=len(rows)) if counts is None else np.add.reduceat(counts[order], at)
    return rows[order[at]], sums


class HatTrie:
    """Counts of phrases of up to ``longest`` words. Below a word there is a container of the words after it, or a branch by
    the next word once the container has burst. A container maps the bytes of the remaining numbers to their count."""

    def __init__(self, longest: int = LONGEST, burst: int = BURST):
        self.longest, self.burst, self.entries = longest, burst, 0
        self.root: dict[int, _Node] = {}

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct ascending phrases with their counts."""
        if not len(rows):
            return
        width = 8 * (self.longest - 1)
        rest = np.ascontiguousarray(rows[:, 1:]).view(f"V{width}").ravel().tolist()
        first, counts = rows[:, 0], counts.tolist()
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])).tolist()
        for low, high, word in zip(starts, [*starts[1:], len(rest)], first[starts].tolist()):
            node = self.root.get(word)
            if node is None:
                node = self.root[word] = _Node()
            self.entries += node.add(rest[low:high], counts[low:high], self.burst, self.longest - 1)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out the largest subtrees until at most ``keep`` phrases are left; returns those taken, with their counts."""
        phrases, counts = [], []
        for word in sorted(self.root, key=lambda w: -self.root[w].entries):
            if self.entries <= keep:
                break
            node = self.root.pop(word)
            self.entries -= node.entries
            node.collect(struct.pack("<q", word), phrases, counts)
        rows = np.frombuffer(b"".join(phrases), np.int64).reshape(-1, self.longest)
        return rows, np.array(counts, np.int64)


class _Node:
    __slots__ = ("container", "branches", "entries")

    def __init__(self):
        self.container: dict[bytes, int] | None = {}
        self.branches: dict[bytes, _Node] = {}
        self.entries = 0

    def add(self, keys: list[bytes], counts: list[int], burst: int, depth: int) -> int:
        """Adds keys of ``depth`` numbers; returns how many are new."""
        if self.container is not None:
            container, before = self.container, len(self.container)
            get = container.get
            for key, n in zip(keys, counts):
                container[key] = get(key, 0) + n
            new = len(container) - before
            self.entries += new
            if len(container) > burst and depth > 1:
                keys, counts, self.container = list(container), list(container.values()), None
                self._deal(keys, counts, burst, depth)
            return new
        new = self._deal(keys, counts, burst, depth)
        self.entries += new
        return new

    def _deal(self, keys: list[bytes], counts: list[int], burst: int, depth: int) -> int:
        groups: dict[bytes, tuple[list[bytes], list[int]]] = {}
        for key, n in zip(keys, counts):
            group = groups.setdefault(key[:8], ([], []))
            group[0].append(key[8:])
            group[1].append(n)
        new = 0
        for word, (rest, n) in groups.items():
            branch = self.branches.get(word)
            if branch is None:
                branch = self.branches[word] = _Node()
            new += branch.add(rest, n, burst, depth - 1)
        return new

    def collect(self, head: bytes, phrases: list[bytes], counts: list[int]) -> None:
        if self.container is not None:
            phrases.extend([head + key for key in self.container])
            counts.extend(self.container.values())
        for word, branch in self.branches.items():
            branch.collect(head + word, phrases, counts)


def pack_run(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """A run, its numbers as differences to the row before where these are small, in planes of bytes, compressed."""
    table = np.concatenate([rows.view(np.uint64), counts[:, None].view(np.uint64)], axis=1)
    table[1:, 0] -= table[:-1, 0].copy()
    planes = np.ascontiguousarray(table.T).view(np.uint8).reshape(table.shape[1], -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_run(data: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(longest + 1, 8, -1)
    table = np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(longest + 1, -1).view(np.uint64).copy()
    table[0] = np.cumsum(table[0], dtype=np.uint64)
    return np.ascontiguousarray(table[:-1].T).view(np.int64), table[-1].view(np.int64).copy()


def partition_of(rows: np.ndarray, parts: int, hot: int) -> np.ndarray:
    """The partition of each phrase by its prefix: up to the first word whose number is not below ``hot``, two words at least."""
    place = np.zeros(len(rows), np.uint64)
    open_ = np.ones(len(rows), bool)
    for k, column in enumerate(rows.T):
        place = np.where(open_, mixed(place * np.uint64(MULTIPLIER) + column.view(np.uint64)), place)
        frequent = (column >= 1) & (column <= hot)
        cool = ~frequent if k == 0 else cool | ~frequent
        if k:
            open_ &= ~cool
    return ((place >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def phrase_counts(rows: DataFrame, lexicon: Lexicon, parts: int, hot: int, longest: int, least: int, entries: int, burst: int) -> DataFrame:
    """numbers (of words) and f of all phrases of two words or more that occur ``least`` times, for (lang, text) rows."""
    sent = rows.sparkSession.sparkContext.broadcast((lexicon.hashes, lexicon.numbers, lexicon.complete))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon.__new__(Lexicon)
        known.hashes, known.numbers, known.complete = sent.value
        words, trie = Words(), HatTrie(longest, burst)

        def runs(keep: int) -> pa.RecordBatch:
            found, counts = trie.spill(keep)
            part = partition_of(found, parts, hot)
            order = np.lexsort((*found.view(np.uint64).T[::-1], part))
            found, counts, part = found[order], counts[order], part[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            cuts = [*starts[1:].tolist(), len(part)]
            packed = [pack_run(found[low:high], counts[low:high]) for low, high in zip(starts.tolist(), cuts)]
            return pa.RecordBatch.from_pydict({"part": pa.array(part[starts], pa.int64()), "run": pa.array(packed, pa.binary())})

        for batch in batches:
            for data, offsets, langs in windows_of(batch, words):
                _, _, hashes, _, piece = words(data, offsets, language_hashes(langs))
                numbers, usable = known(hashes)
                trie.add(*distinct(phrases_at(numbers, usable, piece, longest)))
                if trie.entries > entries:
                    yield runs(entries // 2)
        yield runs(0)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        opened = [unpack_run(run, longest) for run in group["run"]]
        table, counts = distinct(np.concatenate([x for x, _ in opened]), np.concatenate([n for _, n in opened]))
        del opened
        found, sums, whole = [], [], []
        for size in range(2, longest + 1):
            has = table[:, size - 1] != 0
            part, n = table[has, :size], counts[has]
            if not len(part):
                break
            fresh = np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)])
            at = np.flatnonzero(fresh)
            part, total = part[at], np.add.reduceat(n, at)
            spread = ((part >= 1) & (part <= hot)).all(axis=1)
            keep = spread | (total >= least)
            found.extend(part[keep])
            sums.append(total[keep])
            whole.append(~spread[keep])
        if not found:
            return pd.DataFrame({"numbers": pd.Series([], dtype=object), "f": np.zeros(0, np.int64), "whole": np.zeros(0, bool)})
        return pd.DataFrame({"numbers": [x.tolist() for x in found], "f": np.concatenate(sums), "whole": np.concatenate(whole)})

    merged = rows.mapInArrow(count, "part long, run binary").groupBy("part").applyInPandas(merge, "numbers array<long>, f long, whole boolean")
    return merged.groupBy("numbers").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE,
    top: int = TOP, ranked: int = RANKED, part_words: int = PART_WORDS, entries: int = TRIE_ENTRIES, burst: int = BURST,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those at blanks and tabs into words. A
    phrase has 2 to ``longest`` words of a piece and occurs a >= ``least`` times, overlaps included. Cut into two parts that
    occur l and r times among n words, its score is floor(1000 a n / (l r)), for the cut with the lowest one, the earliest of
    equal ones. Phrases inside a longer one that occurs at least ``share`` per cent as often are left out. Order: score and
    a descending, then the phrase by its bytes. A null text counts as empty, a null language as ``und``. Equal rows count
    each. Tables without phrases give an empty result; other columns are not read.

    ``ranked``, ``part_words``, ``entries`` and ``burst`` change the route only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = settle_at(word_counts(rows), new_path(spark, "words"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= least).alias("usable")).first()
    frequent = top_rows(words.filter(F.col("n") >= least).select("hash", "n"), ranked, -F.col("n"), F.shiftright("hash", 1))
    head = sorted((-row["n"], row["hash"]) for row in frequent.collect())  # at most ``ranked`` pairs of numbers
    numbers = pd.DataFrame({"hash": np.array([h for _, h in head], np.int64), "number": np.arange(len(head))})
    numbers = spark.createDataFrame(numbers, "hash long, number long")
    lexicon = Lexicon(np.array([h for _, h in head], np.int64).view(np.uint64), total["usable"] <= ranked)
    hot = sum(-n >= part_words / 2 for n, _ in head)
    parts = -(-(total["n"] or 1) // part_words)
    known = words.filter(F.col("n") >= least).join(numbers, "hash", "left")
    number = F.when(F.col("number").isNotNull(), F.col("number") + 1).otherwise(F.col("hash").bitwiseOR(F.lit(-(1 << 63))))
    known = settle_at(known.select("lang", "word", "n", number.alias("number")), new_path(spark, "numbers"))
    phrases = phrase_counts(rows, lexicon, parts, hot, longest, least, entries, burst)
    phrases = settle_at(phrases, new_path(spark, "phrases"))
    return best(scored(undominated(phrases, share), phrases, known), known, sizes, top)


def undominated(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases that no longer one contains and nearly matches. One word more is enough to look at: the phrases between a
    short and a long one occur at least as often as the long one."""
    longer = phrases.filter(F.size("numbers") > 2)
    ends = F.array(F.expr("slice(numbers, 1, size(numbers) - 1)"), F.expr("slice(numbers, 2, size(numbers) - 1)"))
    inner = longer.select(F.explode(ends).alias("numbers"), "f").groupBy("numbers").agg(F.max("f").alias("around"))
    joined = phrases.join(inner, "numbers", "left")
    return joined.filter(F.col("around").isNull() | (F.col("around") * 100 < F.col("f") * share)).drop("around")


def scored(kept: DataFrame, phrases: DataFrame, known: DataFrame) -> DataFrame:
    """numbers, f and for every cut its place k and the counts l and r of both parts."""
    counts = phrases.unionByName(known.select(F.array("number").alias("numbers"), F.col("n").alias("f")))
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size(numbers) - 1)")))
    cuts = cuts.withColumns({"first": F.expr("slice(numbers, 1, k)"), "rest": F.expr("slice(numbers, k + 1, size(numbers) - k)")})
    left = counts.select(F.col("numbers").alias("first"), F.col("f").alias("l"))
    right = counts.select(F.col("numbers").alias("rest"), F.col("f").alias("r"))
    return cuts.join(left, "first").join(right, "rest").select("numbers", F.col("f").alias("a"), "k", "l", "r")


def best(cuts: DataFrame, known: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language by their lowest cut. Ranks are cut in slices before a language meets."""
    spelled = (
        cuts.select("numbers").distinct().select("numbers", F.posexplode("numbers").alias("at", "number"))
        .join(known.select("number", "word", "lang"), "number")
        .groupBy("numbers").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("numbers", "lang", F.concat_ws(" ", F.col("words.word")).alias("phrase"))
    )
    sized = spelled.join(F.broadcast(sizes), "lang")
    score = F.expr("(1000BD * cast(a AS decimal(16,0)) * cast(n AS decimal(16,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    lowest = (
        cuts.join(sized, "numbers").withColumn("score", score)
        .groupBy("numbers").agg(
            F.min(F.struct("score", "k", "l", "r")).alias("cut"), *(F.first(c).alias(c) for c in ("lang", "phrase", "a", "n"))
        )
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = lowest.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    near = near.filter(F.col("rank") <= top).drop("rank", "salt")
    ranks = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranks.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
