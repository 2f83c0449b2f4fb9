import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import call_ledger


def requests(spark, n=200):
    rows = [(f"r{i}", "be brief", f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, system string, user string")


def noting_client(folder, broken=(), hard=()):
    """A client that leaves a file per call; raises on some ids, or ends its process."""

    def make():
        def client(batch: pd.DataFrame) -> pd.Series:
            if set(batch["id"]) & set(hard):
                os._exit(1)
            if set(batch["id"]) & set(broken):
                raise RuntimeError("limit reached")
            name = os.path.join(folder, uuid.uuid4().hex)
            with open(name, "w") as file:
                file.write("\n".join(batch["id"]))
            return "answer to " + batch["user"]

        return client

    return make


def calls(folder):
    return sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().split("\n"))


def test_answered_requests_are_never_asked_again(spark, tmp_path):
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    asked = requests(spark)
    broken = {"r3", "r77", "r150"}
    first = call_ledger.answer(asked, noting_client(str(folder), broken), ledger, shard_rows=20, batch_rows=5).collect()
    before = calls(folder)
    assert 0 < len(first) < 200 and {r["id"] for r in first} == set(before) and not broken & set(before)
    failed = {r["id"] for r in call_ledger.failures(spark, ledger).collect()}
    assert failed & broken and len(failed) <= 15 and not failed & set(before)  # a failed batch counts as a whole
    second = call_ledger.answer(asked, noting_client(str(folder)), ledger, shard_rows=20).collect()
    assert {(r["id"], r["content"]) for r in second} == {(f"r{i}", f"answer to text {i}") for i in range(200)}
    assert calls(folder) == sorted(f"r{i}" for i in range(200))  # each one once
    third = call_ledger.answer(asked, noting_client(str(folder)), ledger)
    assert third.count() == 200 and len(calls(folder)) == 200
    assert call_ledger.failures(spark, ledger).collect() == []


def test_a_job_that_ends_early_keeps_its_finished_shards(spark, tmp_path):
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    asked = requests(spark, 64)
    with pytest.raises(Exception):
        call_ledger.answer(asked, noting_client(str(folder), hard={"r9"}), ledger, shard_rows=1).collect()
    kept = {r["id"] for r in call_ledger.read_ledger(spark, ledger).collect()}
    before = calls(folder)
    assert kept and kept <= set(before)
    found = call_ledger.answer(asked, noting_client(str(folder)), ledger, shard_rows=8)
    assert found.count() == 64
    after = calls(folder)
    assert all(after.count(i) == 1 for i in kept)


def test_rounds_single_out_a_request_that_always_fails(spark, tmp_path):
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    found = call_ledger.answer_all(requests(spark, 60), noting_client(str(folder), {"r5"}), ledger, shard_rows=16)
    assert {r["id"] for r in found.collect()} == {f"r{i}" for i in range(60) if i != 5}
    assert [(r["id"], r["failures"], r["last_error"]) for r in call_ledger.failures(spark, ledger).collect()] == [
        ("r5", 3, "RuntimeError: limit reached")
    ]
    assert len(calls(folder)) == 59


def test_repeated_null_and_new_requests(spark, tmp_path):
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    rows = [("a", "s", "two"), ("a", "s", "one"), (None, "s", "three"), ("b", None, None)]
    asked = spark.createDataFrame(rows, "id string, system string, user string").withColumn("content", F.lit("x"))
    found = call_ledger.answer(asked, noting_client(str(folder)), ledger).collect()
    assert {r["id"]: r["content"] for r in found} == {"a": "answer to one"}  # no text, no answer
    assert [r["last_error"] for r in call_ledger.failures(spark, ledger).collect()] == ["no answer"]
    more = asked.filter("id = 'a'").union(spark.createDataFrame([("c", "s", "four", "x")], asked.schema))
    assert call_ledger.answer(more, noting_client(str(folder)), ledger).count() == 2 and sorted(calls(folder)) == ["a", "b", "c"]
    assert call_ledger.answer(asked.limit(0), noting_client(str(folder)), str(tmp_path / "none")).collect() == []
