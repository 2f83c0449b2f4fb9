"""Language identification by prediction by partial matching over bytes.

For each language a context tree of bytes up to ``DEPTH`` is counted on a bounded sample and then frozen. A byte's
probability in a context follows method C: seen symbols share total / (total + distinct) by their counts, the rest escapes
to the next shorter context, without the symbols already seen (exclusion); after the empty context all symbols are equally
likely. A context that the samples of all languages together hold fewer than ``LEAST_SEEN`` times has no node of its own: what
follows it once says little, and such contexts are most of a tree. As the statistics are frozen, the code length of every
(context, byte) is worked out once, and a text's exact code length in a language is the sum over its bytes. The language with
the shortest code wins.

Texts are compared in lower case, with anything but letters read as one space, so digits and signs carry no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import folds

DEPTH, PER_LANGUAGE, LEAST_SEEN = 3, 2_000, 2
PAD, WINDOW = b" " * DEPTH, 1 << 18
UNDETERMINED = "und"


def normal(text: str, table: bytes) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(table).split())


def letters_table() -> bytes:
    """ASCII letters and bytes from 0x80 stay, all else is a space."""
    return bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_contexts(sample: DataFrame, text: str, label: str) -> DataFrame:
    """How often each string of ``DEPTH`` + 1 bytes occurs per language: (label, gram long, n long).

    Rows are pre-aggregated per batch, then summed. A text starts after ``DEPTH`` spaces.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters_table()
        for batch in batches:
            frame = batch.to_pandas()
            for name, part in frame.groupby("label"):
                joined = PAD + PAD.join(normal(t, table) for t in part["text"])
                data = np.frombuffer(joined, np.uint8).astype(np.int64)
                if len(data) <= DEPTH:
                    continue
                gram = sum(data[i : len(data) - DEPTH + i] << (8 * (DEPTH - i)) for i in range(DEPTH + 1))
                grams, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_pydict({"label": [name] * len(grams), "gram": grams, "n": n})

    rows = sample.filter(F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "label string, gram long, n long")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen code lengths: ``costs[node, symbol]`` has the bits in each language, ``nodes`` the node of each context."""

    def __init__(self, counted, least_seen: int = LEAST_SEEN):
        """``counted``: a pandas frame of (label, gram, n), bounded by the size of the sample."""
        self.languages = sorted(counted["label"].unique())
        grams, n = counted["gram"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)
        language = np.searchsorted(self.languages, counted["label"].to_numpy(str)) if len(grams) else np.zeros(0, int)
        parts = [(grams >> (8 * (DEPTH - i))) & 255 for i in range(DEPTH + 1)]
        seen = np.unique(np.concatenate([*parts, [32]]))
        self.size = len(seen) + 1  # the last symbol stands for bytes never seen
        self.symbols = np.full(256, self.size - 1, np.int32)
        self.symbols[seen] = np.arange(len(seen))
        parts = [self.symbols[p].astype(np.int64) for p in parts]
        self.nodes = np.zeros(self.size**DEPTH, np.int32)
        chance = np.full((1, self.size, len(self.languages)), 1 / 256)
        owners = np.zeros(1, np.int64)  # contexts of the order before, as numbers in base ``size``
        tables = []
        for order in range(DEPTH + 1):
            context = sum((parts[DEPTH - i] * self.size ** (i - 1) for i in range(1, order + 1)), np.zeros(len(grams), np.int64))
            keys, at = np.unique(context, return_inverse=True)
            if order:
                total = np.bincount(at, n, len(keys))
                keep = total >= least_seen
                keys, at, chosen = keys[keep], (np.cumsum(keep) - 1)[at], keep[at]
            else:
                keys, chosen = np.zeros(1, np.int64), np.ones(len(grams), bool)
            counts = np.zeros((len(keys), self.size, len(self.languages)), np.float64)
            np.add.at(counts, (at[chosen], parts[DEPTH][chosen], language[chosen]), n[chosen])
            parent = np.searchsorted(owners, keys % self.size ** max(0, order - 1)) if order else np.zeros(1, np.int64)
            chance = self._blend(counts, chance[parent])
            owners = keys
            tables.append((keys, chance))
        first, costs = 0, []
        for order, (keys, table) in enumerate(tables):
            endings = self.nodes.reshape(-1, self.size**order)  # a view: all contexts by their last ``order`` symbols
            endings[:, keys] = np.arange(first, first + len(keys))
            first += len(keys)
            costs.append(-np.log2(table).reshape(len(keys) * self.size, len(self.languages)))
        self.costs = np.concatenate(costs).astype(np.float32)

    @staticmethod
    def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        unseen = np.where(counts > 0, 0, shorter)
        left = unseen.sum(1, keepdims=True)
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1)
        escape = np.where(left > 0, escape, 0)
        known = np.where(total > 0, counts / np.maximum(total, 1), 0) * (1 - escape)
        return np.maximum(known + escape * unseen / np.where(left > 0, left, 1), 1e-12)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, a row per text and a column per language."""
        data = np.frombuffer(PAD + PAD.join(texts) + b" ", np.uint8)
        symbols = self.symbols[data]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + DEPTH
        context = np.zeros(len(symbols) - DEPTH, np.int32)
        for i in range(DEPTH):
            context = context * np.int32(self.size) + symbols[i : len(symbols) - DEPTH + i]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ends, sums = starts + sizes - DEPTH, np.zeros((len(texts), len(self.languages)))
        for low in range(0, len(context), WINDOW):
            high = min(low + WINDOW, len(context))
            at = self.nodes[context[low:high]].astype(np.int64) * self.size + symbols[low + DEPTH : high + DEPTH]
            running = np.zeros((high - low + 1, len(self.languages)))
            np.cumsum(self.costs[at], axis=0, out=running[1:])
            sums += running[np.clip(ends, low, high) - low] - running[np.clip(starts, low, high) - low]
        return sums


def learn(docs: DataFrame, key: str, text: str, label: str, per_language: int = PER_LANGUAGE) -> ContextTrees:
    """Trees from at most ``per_language`` rows of ``docs`` per language, whole texts."""
    ids = folds.sample_ids(docs.filter(F.col(text).isNotNull()), key, label, per_language)
    chosen = docs.join(F.broadcast(ids.select(key)), key, "left_semi")
    return ContextTrees(count_contexts(chosen.filter(F.col(label).isNotNull()), text, label).toPandas())


class Identifier:
    """Predictions for columns of texts; one object per task, from the attributes of learned trees."""

    def __init__(self, state: dict):
        self.trees, self.table = ContextTrees.__new__(ContextTrees), letters_table()
        vars(self.trees).update(state)

    def __call__(self, column: pa.Array) -> tuple[list[str], list[float], list[float | None]]:
        """Names, scores and bits per byte of the compared bytes."""
        names, scores, rates = [], [], []
        for low, high in _blocks(column):
            raw = column.slice(low, high - low).to_pylist()
            texts = [normal(t, self.table) if has_letter(t) else b"" for t in raw]
            found = [i for i, t in enumerate(texts) if t and self.trees.languages]
            name, score, rate = [UNDETERMINED] * len(raw), [0.0] * len(raw), [None] * len(raw)
            if found:
                bits = self.trees.lengths([texts[i] for i in found])
                least = bits.min(1)
                shares = 1 / np.exp2(least[:, None] - bits).sum(1)
                for i, j, b, s in zip(found, bits.argmin(1).tolist(), least.tolist(), shares.tolist()):
                    name[i], score[i], rate[i] = self.trees.languages[j], s, b / len(texts[i])
            names, scores, rates = names + name, scores + score, rates + rate
        return names, scores, rates


def identify(docs: DataFrame, trees: ContextTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred, score, bits_per_byte for every row.

    score is the winner's share of the probabilities 2^-bits; ties go to the first name. A null text or one without a
    letter is ``und`` with score 0, and so is every text if nothing was learned.
    """
    model = docs.sparkSession.sparkContext.broadcast(vars(trees))
    kind = docs.schema[key].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(model.value)
        for batch in batches:
            names, scores, rates = identifier(batch.column(1))
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(predict, f"key {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose language is determined, whatever the winner's share. Null and empty texts
    and those without a letter go, and every row if nothing was learned; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(vars(trees))
    place = docs.columns.index(text)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(model.value)
        for batch in batches:
            names, _, _ = identifier(batch.column(place))
            yield batch.filter(pa.array([n != UNDETERMINED for n in names], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def _blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters."""
    low, total = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
        if total and total + size > limit:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(column):
        yield low, len(column)
