"""Review vectors and cosine search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.operators import filters
from reviewmill.session import settle

DIMENSIONS = 384
BLOCK_ROWS, TILE, CHUNK = 4096, 256, 1 << 14
SLACK = 1e-9  # above the rounding of the products


def text_vectors(reviews: DataFrame, dims: int = DIMENSIONS, precision: str = "float32", whole: str | None = None) -> DataFrame:
    """Unit-length TF-IDF vectors of whole texts as ``vec``, for every row; a text without words has a zero vector.

    A word's component is the start of its md5 modulo ``dims``, its weight ln((rows + 1) / (rows with it + 1)). Texts are
    read once: their components are counted by a scan and settled as sparse vectors, from which weights and vectors are worked
    out. The other columns travel with them, so keep only those that are needed. ``whole`` names a column with the texts
    that does not travel, instead of ``text``.
    """
    counted = reviews.withColumn("_tf", tx.word_places(reviews.sparkSession, F.col(whole or "text"), dims))
    rows = settle(counted.drop(whole) if whole else counted, "terms")
    stages = [IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_unit")]
    vectors = Pipeline(stages=stages).fit(rows).transform(rows)
    return vectors.withColumn("vec", vector_to_array("_unit", precision)).drop("_tf", "_tfidf", "_unit")


def vector_records(vectors: DataFrame) -> DataFrame:
    """Stored form: an id from the row key, the vector and its length, and metadata (title cut to 200, text to 500
    characters)."""
    return vectors.select(
        F.concat(F.lit("rev_"), F.col("id").cast("string")).alias("id"),
        "asin",
        "rating",
        tx.prefix(F.coalesce("title", F.lit("")), 200).alias("title"),
        tx.prefix(F.coalesce("text", F.lit("")), 500).alias("text"),
        "vec",
        length_of(F.col("vec")).alias("norm"),
    )


def length_of(vec: Column) -> Column:
    return F.sqrt(_dot(vec, vec))


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def search(
    records: DataFrame,
    query: list[float],
    n: int = 10,
    min_rating: float | None = None,
    max_rating: float | None = None,
) -> DataFrame:
    """The ``n`` nearest records within the rating range, distance = 1 - similarity, ties by id.

    Records of length 0 have no direction and are never found. The rating filter reaches the scan; every task keeps its
    ``n`` best rows only.
    """
    literal = F.array(*(F.lit(float(x)) for x in query))
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    similarity = F.try_divide(_dot(F.col("vec"), literal), F.col("norm") * F.lit(length))
    candidates = records.filter(filters.rating_range(min_rating, max_rating))
    scored = candidates.withColumn("distance", 1 - similarity).filter(F.col("distance").isNotNull())
    return scored.drop("vec", "norm").orderBy("distance", "id").limit(n)


def search_many(records: DataFrame, queries: DataFrame, n: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, distance, position): the ``n`` nearest records of each query (query_id, vec), ties by id.

    Queries and records are cut into hashed blocks of about ``block_rows`` rows of one number of components. Every pair of
    blocks meets in one task, which compares them in tiles and hands on at most ``n`` rows per query; the best of those are
    the result. Vectors of different lengths are not compared. Records and queries without a finite length above 0 are left
    out. Distances are those of double precision. ``vector_index`` answers the same with fewer comparisons.
    """
    key, kind = queries.schema["query_id"].dataType.simpleString(), records.schema["id"].dataType.simpleString()
    asked = queries.select(F.col("query_id").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    asked = _blocks(asked.withColumn("norm", length_of(F.col("vec"))), "query", key, block_rows)
    stored = records.select("id", F.col("vec").cast("array<double>").alias("vec"), "norm")
    stored = _blocks(stored, "record", kind, block_rows)
    every = lambda side, other: side[0].withColumn(
        other[1], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other[2] - 1).cast("long")))
    ).groupBy("query", "record", "dims")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        numbers, asked = left["ids"].iloc[0], np.frombuffer(left["units"].iloc[0]).reshape(len(left["ids"].iloc[0]), -1)
        ids, units = right["ids"].iloc[0], np.frombuffer(right["units"].iloc[0]).reshape(len(right["ids"].iloc[0]), -1)
        found = [best_pairs(asked[low : low + TILE], units, n) for low in range(0, len(asked), TILE)]
        rows = np.concatenate([i + k * TILE for k, (i, _, _) in enumerate(found)])
        columns, distances = (np.concatenate([x[part] for x in found]) for part in (1, 2))
        return pd.DataFrame({"query_id": numbers[rows], "id": ids[columns], "distance": distances})

    queries_first, records_first = every(asked, stored), every(stored, asked)
    found = queries_first.cogroup(records_first).applyInPandas(nearest, f"query_id {key}, id {kind}, distance double")
    window = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)


def _blocks(rows: DataFrame, name: str, kind: str, block_rows: int) -> tuple[DataFrame, str, int]:
    """Blocks of (id, vec, norm) as rows (``name``, dims, ids, units), ids in order; ``name``; how many there are at most."""
    rows = rows.filter((F.col("norm") > 0) & (F.col("norm") < float("inf"))).withColumn("dims", F.size("vec"))
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn(name, F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)))

    def store(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        units = np.stack(group["vec"].to_numpy()).astype(float) / group["norm"].to_numpy()[:, None]
        return pd.DataFrame({
            name: [group[name].iloc[0]], "dims": [units.shape[1]], "ids": [group["id"].to_numpy()], "units": [units.tobytes()],
        })

    stored = rows.groupBy(name, "dims").applyInPandas(store, f"{name} long, dims int, ids array<{kind}>, units binary")
    return stored, name, blocks


def best_pairs(asked: np.ndarray, units: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``asked``, row of ``units``, distance) of the ``n`` nearest of each, equal distances in the order of rows.

    The matrix product rounds equal vectors differently by their place, so what may be among the nearest is worked out again.
    """
    products = asked @ units.T
    least = np.partition(products, max(0, len(units) - n), axis=1)[:, max(0, len(units) - n)] if 0 < n else np.full(len(asked), np.inf)
    i, j = np.nonzero(products >= least[:, None] - SLACK)
    parts = [np.einsum("ij,ij->i", asked[i[k : k + CHUNK]], units[j[k : k + CHUNK]]) for k in range(0, len(i), CHUNK)]
    distances = 1 - np.concatenate(parts or [np.zeros(0)])
    order = np.lexsort((j, distances, i))
    i, j, distances = i[order], j[order], distances[order]
    chosen = np.arange(len(i)) - np.searchsorted(i, i) < n
    return i[chosen], j[chosen], distances[chosen]
