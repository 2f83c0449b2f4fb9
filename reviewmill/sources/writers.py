"""Writing tables: guarded loads, verified copies, appends that can be repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill import schemas


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> DataFrame:
    """Create the declared tables if they do not exist; returns one row per table and column."""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{at}")
    described = []
    for name, schema in schemas.TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        layout = " PARTITIONED BY (date)" if name == "product_features" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{layout}")
        table = spark.table(f"{database}.{name}")
        partitions = {c.name for c in spark.catalog.listColumns(f"{database}.{name}") if c.isPartition}
        described += [(name, f.name, f.dataType.simpleString(), f.name in partitions) for f in table.schema.fields]
    return spark.createDataFrame(described, "table_name string, column_name string, data_type string, is_partition boolean")


def table_at(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The parquet table at ``path``, or an empty one if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def with_row_ids(rows: DataFrame, after: int = -1) -> DataFrame:
    """``rows`` with a unique ``id`` above ``after``. Ids become fixed when the rows are written."""
    return rows.select((F.monotonically_increasing_id() + F.lit(after + 1)).alias("id"), "*")


def load_if_empty(df: DataFrame, path: str) -> bool:
    """Write ``df`` only if the target holds no rows; tells whether it wrote."""
    if not table_at(df.sparkSession, path, df.schema).isEmpty():
        return False
    df.write.mode("append").parquet(path)
    return True


def copy_to_warehouse(df: DataFrame, path: str) -> bool:
    """Load a whole table without its surrogate id, in one parallel write, if the target is empty."""
    return load_if_empty(df.drop("id"), path)


def migrate_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """Replace the target by all rows of ``df`` and compare the rows sent with the rows found there."""
    spark = df.sparkSession
    expected = df.count()
    df.drop("id").write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path).agg(F.count("*").alias("rows_written"))
    return written.select(
        F.lit(name).alias("table_name"),
        F.lit(expected).cast("long").alias("rows_expected"),
        "rows_written",
        (F.col("rows_written") == expected).alias("verified"),
    )


def replace_features(features: DataFrame, path: str) -> None:
    """Replace the feature table, one folder per date. AQE sizes the tasks: small dates share one, large ones are split."""
    features.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    schemas.conform(alerts, schemas.ALERT).write.mode("append").parquet(path)


def append_evaluations(evaluations: DataFrame, path: str) -> None:
    """Append rows whose (asin, model_name) is not stored yet, so a rerun adds nothing.

    Of rows with equal keys in the batch the smallest is stored. A null key equals a null key.
    """
    keys = ["asin", "model_name"]
    rows = schemas.conform(evaluations, schemas.EVALUATION)
    rest = [c for c in rows.columns if c not in keys]
    single = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, "row.*")
    stored = table_at(rows.sparkSession, path, schemas.EVALUATION).select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = single["asin"].eqNullSafe(stored["_asin"]) & single["model_name"].eqNullSafe(stored["_model_name"])
    single.join(stored, same, "left_anti").select(rows.columns).write.mode("append").parquet(path)


def write_labels(labels: DataFrame, path: str, mode: str = "append") -> None:
    """Label rows as CSV files with a header. Quotes are doubled and empty texts quoted, so a round trip loses nothing."""
    schemas.conform(labels, schemas.LABELLED_REVIEW).write.mode(mode).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def append_pairs(pairs: DataFrame, path: str) -> None:
    schemas.conform(pairs, schemas.PAIR).write.mode("append").json(path, ignoreNullFields=False)


def write_drift_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
