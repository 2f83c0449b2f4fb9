"""Encoding and decoding with a lexicon of frequent words as a minimal acyclic transducer.

Words are counted over all documents. The most frequent ones are compiled into an automaton whose states share prefixes and
suffixes; every transition has an output, and the outputs along a word add up to its number, by which its ids are found.
The arrays are one file in the shared folder that every worker maps into memory. All distinct words of a batch go through
the automaton at once, a byte per step; words it does not know are merged by the rules of the vocabulary. So the lexicon's
size changes the time, never the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.selection import top_rows
from reviewmill.llm.tokens import WordMerger, WordSplitter
from reviewmill.session import forget, new_path, settle_at

LEXICON_WORDS, LONGEST_WORD, MEMO_WORDS = 100_000, 32, 400_000


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Transitions and ends per state, and the start, for sorted distinct words; equal suffixes share their states."""
    states: list[dict[int, int]] = [{}]
    ends: list[bool] = [False]
    known: dict[tuple, int] = {}
    path = [0]  # states of the last word, not yet shared
    last = b""

    def share(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            shape = (ends[state], tuple(states[state].items()))
            same = known.setdefault(shape, state)
            if same != state:
                states[path[-1]][last[len(path) - 1]] = same

    for word in words:
        depth = 0
        while depth < min(len(word), len(last)) and word[depth] == last[depth]:
            depth += 1
        share(depth)
        for byte in word[depth:]:
            states.append({})
            ends.append(False)
            states[path[-1]][byte] = len(states) - 1
            path.append(len(states) - 1)
        ends[path[-1]] = True
        last = word
    share(0)
    return states, ends, 0


class Transducer:
    """The compiled arrays: sorted transition keys (state * 256 + byte), their targets and outputs, ends, and ids by number."""

    FIELDS = ("keys", "targets", "outputs", "ends", "id_starts", "ids")

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Transducer:
        words = sorted(entries)
        states, ends, start = minimal_automaton(words)
        below: dict[int, int] = {}
        stack = [start]
        while stack:  # words below each state, children first
            state = stack[-1]
            waiting = [t for t in states[state].values() if t not in below]
            if waiting:
                stack.extend(waiting)
                continue
            below[state] = ends[state] + sum(below[t] for t in states[state].values())
            stack.pop()
        number = {state: i for i, state in enumerate(sorted(below))}
        rows = []
        for state in number:
            output = int(ends[state])
            for byte, target in sorted(states[state].items()):
                rows.append((number[state] * 256 + byte, number[target], output))
                output += below[target]
        self, table = cls(), np.array(rows, np.int64).reshape(-1, 3)
        self.keys, self.targets, self.outputs = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.ends = np.array([ends[state] for state in number], bool)
        sizes = [len(entries[w]) for w in words]
        self.id_starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.array([i for w in words for i in entries[w]], np.uint32)
        return self

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, name) for name in self.FIELDS]
        head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
        return struct.pack("<I", len(head)) + head + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """The arrays of a file, mapped, not read."""
        self, data = cls(), np.memmap(path, np.uint8, "r")
        size = struct.unpack("<I", data[:4].tobytes())[0]
        at = 4 + size
        for name, (kind, length) in zip(cls.FIELDS, json.loads(data[4:at].tobytes())):
            width = np.dtype(kind).itemsize * length
            setattr(self, name, np.frombuffer(data[at : at + width], kind))
            at += width
        return self

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that the lexicon does not have."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        found, state, total = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        active, step = np.arange(len(words)), 0
        while len(active) and len(self.keys):
            done = sizes[active] == step
            at = active[done]
            found[at] = np.where(self.ends[state[at]], total[at], -1)
            active = active[~done]
            if not len(active):
                break
            key = state[active] * 256 + data[starts[active] + step]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            active, place = active[hit], place[hit]
            state[active] = self.targets[place]
            total[active] += self.outputs[place]
            step += 1
        return found

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.id_starts[number] : self.id_starts[number + 1]]


def frequent_words(docs: DataFrame, text: str = "text", n: int = LEXICON_WORDS) -> list[str]:
    """The ``n`` most frequent words of all documents, of at most ``LONGEST_WORD`` characters; ties by a hash.

    The counts are settled and cut by repeated histograms, so only the ``n`` rows come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = WordSplitter()
        for batch in batches:
            counts: Counter[str] = Counter()
            texts = [t for t in batch.column(0).to_pylist() if t]
            for low in range(0, len(texts), 512):
                for words in split(texts[low : low + 512]):
                    counts.update(words)
            short = [w for w in counts if len(w) <= LONGEST_WORD]
            yield pa.RecordBatch.from_pydict({"word": pa.array(short, pa.string()), "n": pa.array([counts[w] for w in short], pa.int64())})

    counted = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    path = new_path(docs.sparkSession, "words")
    top = top_rows(settle_at(counted, path), n, -F.col("n"), F.shiftright(F.xxhash64("word"), 1))
    words = [row["word"] for row in top.select("word").collect()]
    forget(docs.sparkSession, path)
    return words


def build(words: list[str], vocabulary: str) -> Transducer:
    merge = WordMerger(vocabulary)
    return Transducer.compile({w.encode(): merge(w) for w in words})


def publish(docs: DataFrame, lexicon: Transducer) -> str:
    """Write the lexicon to the shared folder and hand it to all workers; returns its file name there.

    The driver writes by Hadoop's file system, and Spark copies the file, so any store that Spark knows will do.
    """
    spark = docs.sparkSession
    path = new_path(spark, "lexicon") + ".bin"
    uri = path if ":" in path.split("/")[0] else f"file://{path}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(lexicon.to_bytes())
    stream.close()
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[1]


class Encoder:
    """Ids and decoded text of documents. Looked-up words are remembered, up to ``MEMO_WORDS`` of them."""

    def __init__(self, lexicon: Transducer, vocabulary: str):
        self.lexicon, self.merge, self.split = lexicon, WordMerger(vocabulary), WordSplitter()
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        special = sorted(self.merge.special, key=len, reverse=True)
        self.parts = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else lambda text: [text]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > MEMO_WORDS:
            self.ids, self.shown, new = {}, {}, list(words)
        for word, number in zip(new, self.lexicon.find([w.encode() for w in new]).tolist()):
            ids = self.lexicon.ids_of(number).tolist() if number >= 0 else self.merge(word)
            self.ids[word], self.shown[word] = struct.pack(f"<{len(ids)}I", *ids), self.merge.text(ids)

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The ids as little-endian unsigned 32-bit integers and the decoded text, for each text."""
        pieces = [self.parts(t) if "<|" in t else [t] for t in texts]
        words = iter(self.split([p for part in pieces for p in part[::2]]))
        split = [[next(words) for _ in part[::2]] for part in pieces]
        self.learn(set().union(*(w for part in split for w in part)))
        for part, plain in zip(pieces, split):
            ids, shown = [], []
            for i, found in enumerate(plain):
                if found:
                    ids.append(b"".join([self.ids[w] for w in found]))
                    shown.append(" ".join([self.shown[w] for w in found]))
                if 2 * i + 1 < len(part):
                    ids.append(struct.pack("<I", self.merge.special[part[2 * i + 1]]))
                    shown.append(part[2 * i + 1])
            yield b"".join(ids), " ".join(shown)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """``key``, ids (little-endian unsigned 32-bit integers) and the decoded text of every row; a null text counts as empty."""
    kind = docs.schema[key].dataType.simpleString()
    return _encoded(docs, vocabulary, key, text, words, f"key {kind}, ids binary, decoded string", lambda ids, shown: (ids, shown))


def encode_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 for every row."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digest(ids: bytes, shown: str) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()

    return _encoded(docs, vocabulary, key, text, words, schema, digest)


def _encoded(docs, vocabulary, key, text, words, schema, result) -> DataFrame:
    name = publish(docs, build(frequent_words(docs, text, words), vocabulary))
    columns = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Transducer.mapped(SparkFiles.get(name)), vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= 1 << 20):
                    size += len(texts[high])
                    high += 1
                found = [result(*pair) for pair in encoder(texts[low:high])]
                values = [pa.array([row[i] for row in found]) for i in range(len(columns) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *values], columns)
                low = high

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
