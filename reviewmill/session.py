"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on. Cluster deployments pass their own master and sizes."""
    builder = (
        SparkSession.builder.appName("reviewmill")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, which the deployment sets."""
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if not configured:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    return configured.rstrip("/")


_scratch: contextvars.ContextVar[str] = contextvars.ContextVar("scratch", default="")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, inside a ``scratch`` block in the block's own folder."""
    return f"{shared_dir(spark)}/reviewmill/{_scratch.get()}{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted in the end, also after an error. Results must have been written elsewhere by then, to
    a path that was made before the block."""
    own = f"{_scratch.get()}scratch-{uuid.uuid4().hex}/"
    token = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(token)
        forget(spark, f"{shared_dir(spark)}/reviewmill/{own.rstrip('/')}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back, so later passes do not recompute it."""
    return settle_at(df, new_path(df.sparkSession, name))


def settle_at(df: DataFrame, path: str) -> DataFrame:
    """``settle`` at a path of the caller, who can ``forget`` it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete settled tables that no plan reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        target = hadoop(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside hand Python at most ``rows`` rows at a time, for rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
