"""Latent vectors: TF-IDF rows on their leading singular directions, so texts that share topics are near without shared words.

The directions come from a randomised range finder with subspace iterations. Every round each task multiplies its rows with the
current basis and back, and hands on one terms x width matrix in slices; the slices of all tasks are summed in two steps. The
driver sees that sum and orthogonalises it: a matrix whose size does not depend on the number of rows. Rounds multiply in single
precision and add up in double; singular values, the turn to their directions and the vectors are of double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.functions.phrases import unpacked
from reviewmill.session import settle

TERMS, WIDTH, EXTRA, ROUNDS, SEED = 4096, 64, 16, 6, 5
SLICES, FAN, BLOCK = 16, 64, 1 << 20  # numbers of a full matrix


def term_counts(reviews: DataFrame, terms: int = TERMS, key: str = "id", text: str = "text") -> DataFrame:
    """(``key``, terms): the hashed words of each text with their counts, packed and settled; texts are read here only."""
    return settle(reviews.select(F.col(key), tx.packed_words(reviews.sparkSession, F.col(text), terms).alias("terms")), "term-counts")


def term_lists(reviews: DataFrame, terms: int = TERMS, key: str = "id", text: str = "text") -> DataFrame:
    """``term_counts`` with the hashed words of each text as lists."""

    def unpack(packed: pa.Array) -> pa.Array:
        row, term, count = entries(packed, terms)
        at = np.append(0, np.cumsum(np.bincount(row, count, len(packed)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.repeat(term.astype(np.int32), count)))

    return term_counts(reviews, terms, key, text).select(key, F.arrow_udf(unpack, "array<int>")("terms").alias("terms"))


def entries(column: pa.Array, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and counts of the distinct terms of each text, in order, of lists or packed."""
    if pa.types.is_struct(column.type):
        return unpacked(column, terms)
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    entry = np.repeat(np.arange(len(column)) * terms, sizes) + column.flatten().to_numpy(zero_copy_only=False)
    entry, count = np.unique(entry, return_counts=True)
    return *np.divmod(entry, terms), count


def summed(lists: DataFrame, shape: tuple[int, int], add: Callable[[pa.Array, np.ndarray], None]) -> np.ndarray:
    """The sum over all batches of what ``add`` adds of a batch of lists to a matrix of this shape."""
    cuts = np.linspace(0, shape[0], SLICES + 1).astype(int).tolist()

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            add(batch.column(0), total)
        parts = [total[low:high].tobytes() for low, high in zip(cuts, cuts[1:])]
        group = [TaskContext.get().partitionId() % FAN] * SLICES
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "fan": pa.array(group, pa.int32()), "data": pa.array(parts, pa.binary())})

    def of_group(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group["data"].iloc[0]).copy()
        for data in group["data"].iloc[1:]:
            total += np.frombuffer(data)
        return group[["slice", "fan"]].iloc[:1].assign(data=[total.tobytes()])

    schema = "slice int, fan int, data binary"
    parts = lists.select("terms").mapInArrow(of_task, schema)
    sums = parts.groupBy("slice", "fan").applyInPandas(of_group, schema).groupBy("slice").applyInPandas(of_group, schema)
    out = np.zeros(shape)
    for row in sums.collect():  # one row per slice
        low, high = cuts[row["slice"]], cuts[row["slice"] + 1]
        out[low:high] = np.frombuffer(row["data"]).reshape(-1, shape[1])
    return out


def term_weights(lists: DataFrame, terms: int = TERMS) -> np.ndarray:
    """ln((rows + 1) / (rows with the term + 1)) of each term."""

    def count(column: pa.Array, total: np.ndarray) -> None:
        total[:terms, 0] += np.bincount(entries(column, terms)[1], minlength=terms)
        total[terms, 0] += len(column)

    found = summed(lists, (terms + 1, 1), count)[:, 0]
    return np.log((found[terms] + 1) / (found[:terms] + 1))


class Rows:
    """Unit TF-IDF rows of a batch."""

    def __init__(self, column: pa.Array, weights: np.ndarray):
        self.column, self.weights = column, weights
        self.n, self.terms = len(column), len(weights)

    def blocks(self, kind: np.dtype) -> Iterator[tuple[slice, np.ndarray | slice, np.ndarray]]:
        """Some rows, the terms in them, and their values as a full matrix: products of it cost a fraction of adding up entries."""
        step = max(1, BLOCK // max(1, self.terms))
        for low in range(0, self.n, step):
            part = self.column.slice(low, step)
            row, term, count = entries(part, self.terms)
            if not len(row):
                continue
            value = count * self.weights[term]
            length = np.sqrt(np.bincount(row, value**2, len(part)))
            value /= np.where(length > 0, length, 1)[row]
            found = np.zeros(self.terms, bool)
            found[term] = True
            terms, width = np.flatnonzero(found), int(found.sum())
            if 2 * width > self.terms:  # choosing terms would cost more than it saves
                terms, width = slice(None), self.terms
            else:
                term = (np.cumsum(found) - 1)[term]
            full = np.zeros((len(part), width), kind)
            full.ravel()[row * width + term] = value
            yield slice(low, low + len(part)), terms, full

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The rows multiplied with a terms x width matrix, in its precision."""
        out = np.zeros((self.n, basis.shape[1]), basis.dtype)
        for rows, terms, full in self.blocks(basis.dtype):
            out[rows] = full @ basis[terms]
        return out

    def add_gram_times(self, basis: np.ndarray, into: np.ndarray) -> None:
        """Adds the product of the transposed rows, the rows and a terms x width matrix."""
        for _, terms, full in self.blocks(basis.dtype):
            into[terms] += full.T @ (full @ basis[terms])


def gram_times(lists: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T (A basis) for the rows A of all texts, multiplied in single precision."""
    sent = lists.sparkSession.sparkContext.broadcast((weights, basis.astype(np.float32)))

    def add(column: pa.Array, total: np.ndarray) -> None:
        weights, basis = sent.value
        Rows(column, weights).add_gram_times(basis, total)

    return summed(lists, basis.shape, add)


def gram_within(lists: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(A basis)^T (A basis) for the rows A of all texts."""
    sent = lists.sparkSession.sparkContext.broadcast((weights, basis))

    def add(column: pa.Array, total: np.ndarray) -> None:
        weights, basis = sent.value
        found = Rows(column, weights).times(basis)
        total += found.T @ found

    return summed(lists, (basis.shape[1],) * 2, add)


@dataclass
class Latent:
    """Term weights, and the leading singular values with their directions as columns."""

    weights: np.ndarray
    values: np.ndarray
    directions: np.ndarray


def fit(lists: DataFrame, terms: int = TERMS, width: int = WIDTH, extra: int = EXTRA, rounds: int = ROUNDS) -> Latent:
    """The ``width`` largest singular values of the unit TF-IDF rows and their directions. The start is seeded, so a repeated
    fit of the same rows differs by rounding only."""
    weights = term_weights(lists, terms)
    basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(terms, min(terms, width + extra))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(gram_times(lists, weights, basis))[0]
    squares, turn = np.linalg.eigh(gram_within(lists, weights, basis))
    best = np.argsort(-squares)[:width]
    directions = basis @ turn[:, best]
    sign = np.sign(directions[np.abs(directions).argmax(0), np.arange(len(best))])  # the largest entry is positive
    return Latent(weights, np.sqrt(np.maximum(squares[best], 0)), directions * sign)


def vectors(lists: DataFrame, model: Latent, key: str = "id") -> DataFrame:
    """(``key``, vec): unit vectors in the latent directions; a text without words, or without any part in them, has zeros."""
    sent = lists.sparkSession.sparkContext.broadcast((model.weights, model.directions))
    kind = lists.schema[key].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, directions = sent.value
        for batch in batches:
            found = Rows(batch.column(1), weights).times(directions)
            length = np.linalg.norm(found, axis=1, keepdims=True)
            found = found / np.where(length > 0, length, 1)
            offsets = np.arange(0, found.size + 1, max(1, found.shape[1]), dtype=np.int32)[: len(found) + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], ["key", "vec"])

    rows = lists.select(F.col(key).alias("key"), "terms")
    return rows.mapInArrow(project, f"key {kind}, vec array<double>").withColumnRenamed("key", key)


def latent_vectors(reviews: DataFrame, key: str = "id", text: str = "text", terms: int = TERMS, width: int = WIDTH) -> DataFrame:
    """(``key``, vec) of whole texts, one row per review."""
    counts = term_counts(reviews, terms, key, text)
    return vectors(counts, fit(counts, terms, width), key)
