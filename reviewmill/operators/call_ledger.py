"""A ledger of model answers: what was paid for is kept, whatever fails later.

Open requests are cut into hashed shards, one task each. A task writes its answers to one file, which is moved into the ledger
when the task is done, not when the job is: a job that fails half way leaves the answers of its finished shards. The next run
asks only for requests without an answer. A client that raises ends its own shard; what it had answered before is kept with
the shard, and the failure is noted there, so one bad request does not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.session import settle
from reviewmill.sources.writers import table_at

SHARD_ROWS, BATCH_ROWS = 1000, 50
# Fixed value: the setting by which a finished task's files go to their place at once.
COMMIT_BY_TASK = ("mapreduce.fileoutputcommitter.algorithm.version", "2")
ASKED_FIRST = "unanswered: the client failed before"


def ledger_schema(kind: T.DataType) -> T.StructType:
    """(id, content, error, attempt): an answer, or a failure without one."""
    return T.StructType([T.StructField("id", kind)]).add("content", "string").add("error", "string").add("attempt", "long")


def read_ledger(spark: SparkSession, path: str, kind: T.DataType = T.StringType()) -> DataFrame:  # noqa: B008
    """One row (id, content, attempt) per answered id. A shard whose task was repeated after its file had moved stands there
    twice; the earliest attempt counts, of equal ones the smaller content."""
    rows = table_at(spark, path, ledger_schema(kind)).filter(F.col("content").isNotNull())
    first = rows.groupBy("id").agg(F.min(F.struct("attempt", "content")).alias("first"))
    return first.select("id", "first.content", "first.attempt")


def failures(spark: SparkSession, path: str, kind: T.DataType = T.StringType()) -> DataFrame:  # noqa: B008
    """(id, failures, last_error) of requests that failed and were not answered since."""
    rows = table_at(spark, path, ledger_schema(kind))
    failed = rows.filter(F.col("error").isNotNull() & (F.col("error") != ASKED_FIRST))
    counted = failed.groupBy("id").agg(F.count("*").alias("failures"), F.max(F.struct("attempt", "error")).alias("last"))
    open_ = counted.join(read_ledger(spark, path, kind), "id", "left_anti")
    return open_.select("id", "failures", F.col("last.error").alias("last_error"))


def open_requests(requests: DataFrame, path: str) -> DataFrame:
    """Requests without an answer in the ledger; of repeated ids the smallest request, a null id has none."""
    done = read_ledger(requests.sparkSession, path, requests.schema["id"].dataType).select("id")
    rows = requests.filter("id IS NOT NULL").join(done, "id", "left_anti")
    return rows.groupBy("id").agg(F.min(F.struct("system", "user")).alias("r")).select("id", "r.system", "r.user")


def answer(
    requests: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], pd.Series]], path: str,
    shard_rows: int = SHARD_ROWS, batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Asks for all open requests and returns the ledger's answers (id, content) to ``requests``.

    ``make_client`` is called once per shard and gives a function from a frame of requests to a series of answers, which is
    asked for ``batch_rows`` at a time; null answers count as failures. Requests that failed stay open for the next call of
    this function. An executor or job that is lost costs the shards it was working on. The ledger's folder must be one whose
    file system can rename.
    """
    spark, kind = requests.sparkSession, requests.schema["id"].dataType
    waiting = settle(open_requests(requests, path), "open-requests")
    count = waiting.count()
    attempt = (table_at(spark, path, ledger_schema(kind)).agg(F.max("attempt")).first()[0] or 0) + 1

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, error = None, None
        for frame in batches:
            for low in range(0, len(frame), batch_rows):
                part = frame.iloc[low : low + batch_rows].reset_index(drop=True)
                found, told = [None] * len(part), ASKED_FIRST
                if error is None:
                    try:
                        client = client or make_client()
                        found = [None if pd.isna(x) else str(x) for x in client(part)]
                        if len(found) != len(part):
                            raise ValueError(f"{len(found)} answers to {len(part)} requests")
                        told = None
                    except Exception as problem:  # any failure of a client is a row of the ledger
                        error, found, told = problem, [None] * len(part), f"{type(problem).__name__}: {problem}"
                errors = [told or (None if x is not None else "no answer") for x in found]
                yield pd.DataFrame({"id": part["id"], "content": found, "error": errors, "attempt": attempt})

    if count:
        shards = -(-count // shard_rows)
        asked = waiting.repartition(shards, F.xxhash64("id")).mapInPandas(ask, ledger_schema(kind))
        asked.write.mode("append").option(*COMMIT_BY_TASK).parquet(path)
    return read_ledger(spark, path, kind).join(requests.select("id").distinct(), "id", "left_semi").select("id", "content")


def answer_all(
    requests: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], pd.Series]], path: str, rounds: int = 3,
    shard_rows: int = SHARD_ROWS, batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """``answer`` until nothing is open, at most ``rounds`` times. Each round deals what is left into smaller shards, down to
    one request each, so a request that always fails stands alone in the end."""
    for number in range(rounds):
        last = number == rounds - 1
        size = 1 if last else max(1, shard_rows // 4**number)
        found = answer(requests, make_client, path, size, 1 if last else min(size, batch_rows))
        if open_requests(requests, path).isEmpty():
            break
    return found
