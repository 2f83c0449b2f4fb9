"""An inverted file over review vectors, for batches of cosine searches.

Centroids are fitted on a bounded sample; every record is stored in the list of its nearest centroid, one folder per list,
with its angle to the centroid. Queries are sent to lists only. The nearest lists of a query give it a bound on its n-th
distance; by the triangle inequality of angles the other lists, and the records within lists, that cannot beat the bound are
left out, so the answer is that of comparing everything. With ``probes`` only that many lists are asked and the answer is
approximate. Lists and the queries for them are cut into blocks, so neither a long list nor a popular one ends in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.operators.search import BLOCK_ROWS, SLACK, TILE, best_pairs, length_of
from reviewmill.session import new_path, settle

LISTS, SAMPLE_ROWS, FIRST_LISTS, ROUNDS, SEED = 1024, 1 << 16, 4, 10, 11


@dataclass
class Index:
    """Folder ``path``/lists of (list, id, vec, angle), and per list its centroid, row count and largest angle."""

    spark: SparkSession
    path: str
    dims: int
    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector has ``dims`` components and a finite length above 0, as doubles, with the length."""
    rows = vectors.withColumn("vec", F.col("vec").cast("array<double>")).filter(F.size("vec") == dims)
    rows = rows.withColumn("norm", length_of(F.col("vec")))
    return rows.filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))


def fit_centroids(records: DataFrame, dims: int, lists: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``lists`` unit centroids of a sample of about ``sample_rows`` records, taken by a hash of the id.

    The sample and its size only decide where the lists are, never what an exact search finds.
    """
    rows = usable(records, dims)
    share = sample_rows / max(1, rows.count())
    place = F.xxhash64(F.col("id"), F.lit(SEED)).cast("double")
    sample = rows.filter(place < (min(1.0, share) * 2 - 1) * 2.0**63) if share < 1 else rows
    sample = settle(sample.select(array_to_vector(F.transform("vec", lambda x: x / F.col("norm"))).alias("features")), "sample")
    if sample.isEmpty():
        return np.zeros((0, dims))
    model = KMeans(k=max(2, lists), distanceMeasure="cosine", maxIter=ROUNDS, seed=SEED).fit(sample)
    found = np.array([c for c in model.clusterCenters()], float).reshape(-1, dims)
    lengths = np.linalg.norm(found, axis=1)
    return found[lengths > 0] / lengths[lengths > 0, None]


def build(records: DataFrame, lists: int | None = None, path: str | None = None, sample_rows: int = SAMPLE_ROWS, dims: int | None = None) -> Index:
    """Store (id, vec) in lists. Other columns are dropped; join them back by id.

    ``dims`` is the most frequent number of components if not given; records of other lengths, null vectors and those without
    a finite length above 0 are left out, as no query of that length can find them. Without ``lists`` there are about as
    many as the square root of the number of records, at most ``LISTS``.
    """
    spark, path = records.sparkSession, path or new_path(records.sparkSession, "index")
    rows = records.select("id", "vec")
    if dims is None:
        sizes = rows.filter("vec IS NOT NULL").groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        dims = sizes["dims"] if sizes else 0
    rows = usable(rows, dims)
    lists = lists or min(LISTS, max(1, math.isqrt(rows.count())))
    centroids = fit_centroids(records.select("id", "vec"), dims, lists, sample_rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = matrix(batch.column(1), dims) / batch.column(2).to_numpy()[:, None]
            near = (units @ centroids.T).argmax(axis=1)
            angle = angles(units, centroids[near])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(near.astype(np.int32))], NAMES)

    kind = rows.schema["id"].dataType.simpleString()
    assigned = rows.mapInArrow(assign, f"id {kind}, vec array<double>, norm double, angle double, list int")
    assigned.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
    stored = spark.read.schema(f"id {kind}, vec array<double>, norm double, angle double, list int").parquet(f"{path}/lists")
    counts, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for row in stored.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():
        counts[row["list"]], radius[row["list"]] = row["n"], row["angle"]
    return Index(spark, path, dims, centroids, counts, radius)


NAMES = ["id", "vec", "norm", "angle", "list"]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Angles between unit vectors, row by row; exact to rounding for small ones too."""
    return 2 * np.arctan2(np.linalg.norm(left - right, axis=1), np.linalg.norm(left + right, axis=1))


def search_index(
    index: Index, queries: DataFrame, n: int = 10, probes: int | None = None, block_rows: int = BLOCK_ROWS, first_lists: int = FIRST_LISTS,
) -> DataFrame:
    """(query_id, id, distance, position): the ``n`` nearest records of each query (query_id, vec), ties by id.

    Exact without ``probes``; with it only the nearest ``probes`` lists of each query are asked. Queries with another number
    of components than the index, null ones and those without a finite length above 0 find nothing. Equal ``query_id`` must
    not stand on different vectors.
    """
    asked = usable(queries.select("query_id", "vec"), index.dims).dropDuplicates(["query_id"])
    asked = settle(asked, "queries")
    if not len(index.centroids) or n <= 0:
        kind = index.lists.schema["id"].dataType.simpleString() if len(index.centroids) else "string"
        return asked.sparkSession.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kind}, distance double, position int")
    near = _visit(index, asked.withColumn("bound", F.lit(math.pi)), n, block_rows, 0, probes or first_lists)
    near = settle(_nearest(near, n), "near")
    if probes:
        return near
    bound = near.groupBy("query_id").agg(F.when(F.count("*") >= n, F.max("distance")).alias("distance"))
    # the angle of the n-th distance so far, with room for rounding; all lists if there are fewer than n
    angle = F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance") - SLACK))), F.lit(math.pi))
    bounded = asked.join(bound, "query_id", "left").select("query_id", "vec", "norm", angle.alias("bound"))
    rest = _visit(index, bounded, n, block_rows, first_lists, None)
    return _nearest(near.drop("position").unionByName(rest), n)


def _nearest(found: DataFrame, n: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)


def lists_to_visit(units: np.ndarray, bound: np.ndarray, index: Index, first: int, last: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``units``, list, angle to its centroid) of the non-empty lists from the ``first``-th to the ``last``-th nearest
    that may hold a record within the bound."""
    filled = np.flatnonzero(index.rows)
    turn = 2 * np.arcsin(np.clip(np.sqrt(np.maximum(0, 2 - 2 * (units @ index.centroids[filled].T))) / 2, 0, 1))
    order = np.argsort(turn, axis=1, kind="stable")[:, first:last]
    rows = np.repeat(np.arange(len(units)), order.shape[1])
    place = order.ravel()
    angle = turn[rows, place]
    keep = angle - index.radius[filled][place] <= bound[rows] + ROUNDING
    return rows[keep], filled[place][keep], angle[keep]


ROUNDING = 1e-6  # above the rounding of angles, which is that of the square root of a product


def _visit(index: Index, asked: DataFrame, n: int, block_rows: int, first: int, last: int | None) -> DataFrame:
    """The best ``n`` records of each query in every block of the lists it visits."""
    key, kind = (s["query_id" if i == 0 else "id"].dataType.simpleString() for i, s in enumerate((asked.schema, index.lists.schema)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = matrix(batch.column(1), index_dims) / batch.column(2).to_numpy()[:, None]
            for low in range(0, len(units), TILE):
                rows, lists, angle = lists_to_visit(units[low : low + TILE], batch.column(3).to_numpy()[low : low + TILE], small, first, last)
                taken = batch.slice(low, TILE).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists.astype(np.int32)), pa.array(angle)], ROUTED)

    small, index_dims = Index(None, "", index.dims, index.centroids, index.rows, index.radius), index.dims
    routed = settle(asked.select("query_id", "vec", "norm", "bound").mapInArrow(
        route, f"query_id {key}, vec array<double>, norm double, bound double, list int, angle double"
    ), "routed")
    wanted = {row["list"]: row["n"] for row in routed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    sizes = [(i, -(-int(index.rows[i]) // block_rows), -(-count // block_rows)) for i, count in sorted(wanted.items())]
    plan = F.broadcast(asked.sparkSession.createDataFrame(sizes, "list int, blocks int, parts int"))  # a row per list at most
    block = lambda column, size: F.pmod(F.xxhash64(column), F.col(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    left = routed.join(plan, "list").withColumn("part", block("query_id", "parts")).withColumn("block", every("blocks"))
    stored = index.lists.filter(F.col("list").isin(sorted(wanted))) if wanted else index.lists.limit(0)
    right = stored.join(plan, "list").withColumn("block", block("id", "blocks")).withColumn("part", every("parts"))
    keys = ["list", "block", "part"]

    def compare(asked: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(records):
            return pd.DataFrame({"query_id": asked["query_id"][:0], "id": records["id"][:0], "distance": np.zeros(0)})
        records = records.sort_values("id", ignore_index=True)
        units, stored = (np.stack(f["vec"].to_numpy()) / f["norm"].to_numpy()[:, None] for f in (asked, records))
        turn, own, bound = asked["angle"].to_numpy(), records["angle"].to_numpy(), asked["bound"].to_numpy()
        near = np.flatnonzero(own >= (turn - bound).min() - ROUNDING)  # nearer to the centroid than any query can use
        near = near[own[near] <= (turn + bound).max() + ROUNDING]
        parts = [best_pairs(units[low : low + TILE], stored[near], n) for low in range(0, len(units) if len(near) else 0, TILE)]
        rows = np.concatenate([np.zeros(0, int), *(i + k * TILE for k, (i, _, _) in enumerate(parts))])
        columns = near[np.concatenate([np.zeros(0, int), *(j for _, j, _ in parts)])]
        distance = np.concatenate([np.zeros(0), *(d for _, _, d in parts)])
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[rows], "id": records["id"].to_numpy()[columns], "distance": distance})

    left = left.select(*keys, "query_id", "vec", "norm", "bound", "angle").groupBy(*keys)
    right = right.select(*keys, "id", "vec", "norm", "angle").groupBy(*keys)
    return left.cogroup(right).applyInPandas(compare, f"query_id {key}, id {kind}, distance double")


ROUTED = ["query_id", "vec", "norm", "bound", "list", "angle"]
