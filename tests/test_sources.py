import datetime

from pyspark.sql import functions as F

from reviewmill import schemas
from reviewmill.operators import sampling
from reviewmill.session import new_path
from reviewmill.sources import readers, writers


def test_normalise_reviews(spark):
    raw = spark.createDataFrame(
        [("a", 3, "1700000000123", 5.0), ("b", None, "soon", 1.0), ("c", 1, None, None)],
        "asin string, helpful_vote int, timestamp string, rating double",
    )
    rows = {r["asin"]: r for r in readers.normalise_reviews(raw).collect()}
    assert readers.normalise_reviews(raw).columns == [f.name for f in schemas.REVIEW.fields]
    assert rows["a"]["helpful_votes"] == 3 and rows["a"]["timestamp"] == datetime.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert rows["b"]["timestamp"] is None and rows["c"]["timestamp"] is None and rows["a"]["title"] is None


def test_normalise_products(spark):
    raw = spark.createDataFrame(
        [("p", "new", ["x", "y"], "Cat", ["f"], 9), ("p", "old", [], "Cat", [], 3), ("q", "only", None, None, ["g", "h"], None),
         ("p", "older", ["z"], "Cat", ["f"], None)],
        "parent_asin string, title string, description array<string>, main_category string, features array<string>, rating_number int",
    )
    rows = {r["parent_asin"]: r for r in readers.normalise_products(raw).collect()}
    assert len(rows) == 2
    assert rows["p"]["title"] == "new" and rows["p"]["description"] == "x; y" and rows["p"]["category"] == "Cat"
    assert rows["q"]["features"] == "g; h" and rows["q"]["description"] is None and rows["q"]["price"] is None


def test_nested_columns_are_dropped(spark):
    raw = spark.createDataFrame([("p", "s")], "parent_asin string, subtitle string")
    assert readers.drop_nested(raw).columns == ["parent_asin"]


def test_csv_round_trip(spark):
    texts = ['say "hi", twice', "two\nlines", "", None, " spaces ", "back\\slash", 'ends with "', "tab\tand,comma"]
    labels = spark.createDataFrame([(i, "a", 1.0, t, t, 1, 0, 0, 0, 0) for i, t in enumerate(texts)], schemas.LABELLED_REVIEW)
    path = new_path(spark, "csv-test")
    writers.write_labels(labels, path)
    stored = readers.read_labels(spark, path).orderBy("id").collect()
    assert [r["text"] for r in stored] == texts and [r["title"] for r in stored] == texts


def test_evaluations_are_appended_once(spark):
    path = new_path(spark, "eval-test")
    rows = spark.createDataFrame([("a", "m", 4.0), ("b", "m", 3.0)], "asin string, model_name string, accuracy double")
    writers.append_evaluations(rows, path)
    writers.append_evaluations(rows.unionByName(spark.createDataFrame([("a", "n", 1.0)], rows.schema)), path)
    assert spark.read.parquet(path).count() == 3


def test_load_if_empty_and_migrate(spark):
    path = new_path(spark, "load-test")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, asin string")
    assert writers.copy_to_warehouse(df, path) and not writers.copy_to_warehouse(df, path)
    assert spark.read.parquet(path).columns == ["asin"] and spark.read.parquet(path).count() == 2
    check = writers.migrate_table(df, "t", new_path(spark, "migrate-test")).first()
    assert check.asDict() == {"table_name": "t", "rows_expected": 2, "rows_written": 2, "verified": True}


def test_repeated_and_null_evaluations_are_stored_once(spark):
    path = new_path(spark, "eval-repeats")
    rows = spark.createDataFrame([("a", "m", 4.0), ("a", "m", 3.0), (None, "m", 1.0), (None, "m", 1.0)], "asin string, model_name string, accuracy double")
    for _ in range(2):
        writers.append_evaluations(rows, path)
    assert sorted((r["asin"] or "", r["accuracy"]) for r in spark.read.parquet(path).collect()) == [("", 1.0), ("a", 3.0)]


def test_loaded_ids_are_unique_and_fixed(spark):
    path = new_path(spark, "ids-test")
    raw = spark.range(500).repartition(5).select(F.col("id").cast("string").alias("user_id"), F.lit("99999999999999999").alias("timestamp"))
    writers.load_if_empty(writers.with_row_ids(readers.normalise_reviews(schemas.conform(raw, schemas.RAW_REVIEW))), path)
    first, second = ({(r["id"], r["user_id"]) for r in spark.read.parquet(path).collect()} for _ in range(2))
    assert first == second and len({i for i, _ in first}) == 500
    assert spark.read.parquet(path).filter("timestamp IS NOT NULL").count() == 0
    assert sampling.sample(spark.read.parquet(path), 20).count() == 20


def test_capped_read_is_repeatable(spark):
    path = new_path(spark, "raw-test")
    raw = spark.range(300).select(F.col("id").cast("string").alias("user_id"), F.lit("x").alias("asin"))
    schemas.conform(raw, schemas.RAW_REVIEW).write.parquet(path)
    a = {r["user_id"] for r in readers.read_raw_reviews(spark, path, 40).collect()}
    assert len(a) == 40 and a == {r["user_id"] for r in readers.read_raw_reviews(spark, path, 40).collect()}
    assert readers.read_raw_reviews(spark, path).count() == 300


def test_scan_pushes_columns_and_filter(spark):
    path = new_path(spark, "scan-test")
    spark.range(10).withColumn("a", F.col("id") * 2).withColumn("b", F.lit("x")).write.parquet(path)
    plan = readers.scan(spark, path, ["a"], F.col("a") > 4)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<a:bigint>" in plan and "GreaterThan(a,4)" in plan
