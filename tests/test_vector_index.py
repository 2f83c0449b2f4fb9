import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import search, vector_index


def clustered(seed=4, groups=12, size=60, dims=16, noise=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return np.concatenate([c + noise * rng.normal(size=(size, dims)) for c in centres]), rng


def table(spark, vectors, name="id", text=True):
    rows = [(f"rev_{i}" if text else i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} {'string' if text else 'long'}, vec array<double>").repartition(5)


def answers(df):
    return sorted((r["query_id"], r["position"], r["id"], round(r["distance"], 9)) for r in df.collect())


def every(vectors, asked, n):
    found = []
    for number, v in enumerate(asked):
        d = [(round(1 - float(v @ x) / np.linalg.norm(v) / np.linalg.norm(x), 9) + 0.0, f"rev_{i}") for i, x in enumerate(vectors)]
        found += [(number, k + 1, i, x) for k, (x, i) in enumerate(sorted(d)[:n])]
    return sorted(found)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_exact_search_equals_all_comparisons(spark, block_rows):
    vectors, rng = clustered()
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 40, 0)])
    asked = [*vectors[::50], *rng.normal(size=(20, 16)), -vectors[3]]
    index = vector_index.build(table(spark, vectors), lists=12)
    queries = table(spark, asked, "query_id", False)
    assert answers(vector_index.search_index(index, queries, 7, block_rows=block_rows)) == every(vectors, asked, 7)


def test_few_lists_are_enough_and_cheap(spark):
    vectors, rng = clustered(groups=20, size=100, dims=32, noise=0.4)
    asked = vectors[rng.choice(len(vectors), 200, False)] + 0.2 * rng.normal(size=(200, 32))
    records, queries = table(spark, vectors), table(spark, asked, "query_id", False)
    index = vector_index.build(records, lists=20)
    wanted = {(q, i) for q, _, i, _ in every(vectors, asked, 10)}
    found = {(q, i) for q, _, i, _ in answers(vector_index.search_index(index, queries, 10, probes=2))}
    assert len(found & wanted) >= 0.9 * len(wanted)
    units, bound = asked / np.linalg.norm(asked, axis=1)[:, None], np.full(len(asked), 0.6)
    rows, _, _ = vector_index.lists_to_visit(units, bound, index, 0, None)
    assert len(rows) < 0.5 * len(asked) * 20  # the bound leaves most lists out


def test_ids_of_any_kind_and_vectors_that_cannot_be_compared(spark):
    rows = [(5, [1.0, 0.0]), (6, [0.0, 3.0]), (7, [1.0, 2.0, 3.0]), (8, None), (9, [0.0, 0.0]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0])]
    records = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = [("a", [2.0, 0.1]), ("b", [1.0, 2.0, 3.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0, None])]
    queries = spark.createDataFrame(asked, "query_id string, vec array<double>")
    index = vector_index.build(records)
    assert [r[:3] for r in answers(vector_index.search_index(index, queries, 2))] == [("a", 1, 5), ("a", 2, 6)]
    stored = records.withColumn("norm", search.length_of(F.col("vec")))
    many = answers(search.search_many(stored, queries, 2))
    assert [r[:3] for r in many] == [("a", 1, 5), ("a", 2, 6), ("b", 1, 7)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, vec array<double>")
    some = spark.createDataFrame([("x", [1.0, 0.0])], "id string, vec array<double>")
    asked = some.withColumnRenamed("id", "query_id")
    assert vector_index.search_index(vector_index.build(none), asked, 3).collect() == []
    index = vector_index.build(some)
    assert vector_index.search_index(index, asked.limit(0), 3).collect() == []
    assert [r["id"] for r in vector_index.search_index(index, asked, 3).collect()] == ["x"]


def test_lists_are_folders_and_only_asked_ones_are_read(spark):
    vectors, _ = clustered(groups=6, size=30)
    index = vector_index.build(table(spark, vectors), lists=6)
    plan = index.lists.filter(F.col("list").isin(1, 2))._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan and int(index.rows.sum()) == len(vectors)
