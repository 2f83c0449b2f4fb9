"""Exact order statistics and exact top-n cuts by repeated histograms.

Each pass is one map-side-combined aggregation with at most ``FANOUT`` result rows. No pass sorts, shuffles or gathers
rows, so ties, skew and the size of n do not matter. Plain ``orderBy().limit(n)`` sends up to n rows of every
partition to one task, which is fine for small n only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.session import forget, new_path, settle_at

FANOUT = 4096
LAST = 2**61  # key of nulls in a descending order


@dataclass
class Cut:
    """Rows before ``value`` in key order number ``before``; rows equal to it number ``ties``."""

    value: int | None
    before: int
    ties: int


def _select_long(
    keys: DataFrame, name: str, rank: int, path: str | None = None, bounds: tuple[int, int] | None = None
) -> tuple[Cut | None, DataFrame]:
    """The value of rank ``rank`` (from 0) in a non-null long column whose range is below 2^63, and the rows that have it.

    Without ``bounds`` of the column a scan finds them. No cut if there are no rows after the rank. With ``path`` the rows
    of the first winning bucket are settled there, and only those are read from then on.
    """
    if not bounds:
        found = keys.agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).first()
        if found["n"] <= rank + 1 and path:
            return None, keys
        bounds = found["lo"], found["hi"]
    (low, high), before = bounds, 0
    while True:
        width = (high - low) // FANOUT + 1
        bucket = F.expr(f"({name} - ({low}L)) div {width}L")
        counts = (
            keys.filter(F.col(name).between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()
        )
        if path and sum(row["n"] for row in counts) <= rank + 1:
            return None, keys
        for b, n in sorted((row["b"], row["n"]) for row in counts):
            if before + n > rank:
                break
            before += n
        low, high = low + b * width, min(low + (b + 1) * width - 1, high)
        if path:
            keys, path = settle_at(keys.filter(F.col(name).between(low, high)), path), None
        if low == high:
            return Cut(low, before, n), keys.filter(F.col(name) == low)


def top_rows(
    df: DataFrame, n: int, *keys: Column, prune: Callable[[int], Column] | None = None, bounds: tuple[int, int] | None = None
) -> DataFrame:
    """Exactly the first ``n`` rows in ascending order of the non-null long ``keys``.

    The keys are narrowed one after another to the key of the last row kept; the result is then a plain filter of
    ``df``. Rows that share all keys at the cut are ordered by a hash of the row, so the same ones are kept on every
    run. With ``bounds`` of the first key, as hashes have them, ``df`` is read three times: for a histogram, for the keys of
    its winning bucket, which are settled and deleted in the end, and for the result; else once more for the bounds.
    ``prune`` turns the cut of the first key into a condition on stored columns that kept rows meet, by which scans can
    skip row groups. The passes run when this is called.
    """
    if n <= 0:
        return df.limit(0)
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    keys = (*keys, F.shiftright(F.xxhash64(*hashed), 1))
    names = [f"key{i}" for i in range(len(keys))]
    open_keys = df.select(*(key.alias(name) for key, name in zip(keys, names)))
    path = new_path(df.sparkSession, "keys")
    kept, open_rows, wanted = F.lit(False), F.lit(True), n
    for i, (key, name) in enumerate(zip(keys, names)):
        cut, open_keys = _select_long(open_keys, name, wanted - 1, *((path, bounds) if i == 0 else ()))
        if cut is None:
            return df
        if prune and i == 0:
            df = df.filter(prune(cut.value))
        kept = kept | (open_rows & (key < F.lit(cut.value)))
        open_rows = open_rows & (key == F.lit(cut.value))
        wanted -= cut.before
        if cut.ties == wanted:
            kept, wanted = kept | open_rows, 0
            break
    forget(df.sparkSession, path)
    # what is still open are equal rows, of which any will do
    return df.filter(kept) if not wanted else df.filter(kept).unionByName(df.filter(open_rows).limit(wanted))


HASH_BOUNDS = 0, 2**60 - 1  # of ``hash_key``


def hash_key(*columns: Column, seed: int | str) -> Column:
    """A 60-bit key from md5 of the columns and a seed: a repeatable random order."""
    digest = F.md5(F.concat_ws("|", *(c.cast("string") for c in columns), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def descending(key: Column) -> Column:
    """A long key that sorts in descending order, nulls at the end."""
    return F.coalesce(-key, F.lit(LAST))


def micros(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp"))


def exact_percentile(df: DataFrame, column: str, fraction: float) -> float | None:
    """The percentile with linear interpolation between ranks, exact on any number of rows. NaN if any value is NaN.

    Doubles are bracketed by value: every pass cuts the bracket that holds the wanted rank into ``FANOUT`` equal
    parts. Each pass reads ``column`` again, so it should come from a stored table or a cheap projection of one.
    Infinite values are counted apart.
    """
    value = F.col(column).cast("double")
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    finite = F.when(F.abs("v") < math.inf, F.col("v"))
    bounds = values.agg(
        F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("nan"), F.count_if(F.col("v") == -math.inf).alias("below"),
        F.count(finite).alias("finite"), F.min(finite).alias("lo"), F.max(finite).alias("hi"),
    ).first()
    if not bounds["n"]:
        return None
    if bounds["nan"]:
        return math.nan
    position = fraction * (bounds["n"] - 1)
    rank, values = int(position), values.filter(F.abs("v") < math.inf)

    def at(place: int) -> float:
        if place < bounds["below"]:
            return -math.inf
        if place >= bounds["below"] + bounds["finite"]:
            return math.inf
        return _select_double(values, place - bounds["below"], bounds["lo"], bounds["hi"])

    low = at(rank)
    if position == rank:
        return low
    high = at(rank + 1)
    return low if low == high else low + (high - low) * (position - rank)


def _select_double(values: DataFrame, rank: int, low: float, high: float) -> float:
    before = 0
    while low < high:
        # halves, as the distance of two large values may not be finite
        place = (F.col("v") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
        part = F.least(F.floor(place * FANOUT), F.lit(FANOUT - 1))
        counts = (
            values.filter(F.col("v").between(low, high))
            .groupBy(part.alias("b"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        for _, n, low, high in sorted(tuple(row) for row in counts):
            if before + n > rank:
                break
            before += n
    return low
