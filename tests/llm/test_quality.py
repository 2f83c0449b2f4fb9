import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reviewmill.llm import quality, registry, texts
from tests.llm import frames

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = registry.QUERIES["op6_quality_classifier"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]).all()
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all() and found["score"].between(0, 1).all()
    held = found[found["held_out"]].merge(labels, on="doc_id")
    accuracy = (held["predicted"] == held["quality"]).mean()
    assert accuracy > max(held["quality"].mean(), 1 - held["quality"].mean()) + 0.05


def test_features_are_unit_vectors_of_counts():
    data, offsets = texts.flat(pa.array(["a a a b!", "", None, "c"]))
    row, index, value = quality.Features(10)(data, offsets)
    assert sorted(set(row.tolist())) == [0, 3]
    assert np.bincount(row, value * value, 4) == pytest.approx([1, 0, 0, 1])
    assert (row == 0).sum() == 6  # a, b, !, the pair of equal words, a-b, b-!
    assert (row == 3).sum() == 1


@pytest.fixture
def learned(spark):
    rows = [(i, ("good words here " if i % 2 else "bad junk !!! ") * (1 + i % 5)) for i in range(80)]
    docs = frames.documents(spark, rows)
    labels = frames.with_clashes(spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None), (5, 7), (999, 1)], "doc_id long, quality int"))
    return docs, labels, quality.train(docs, labels)


def test_learns_and_does_not_depend_on_layout(spark, learned):
    docs, labels, weights = learned
    again = quality.train(docs.repartition(7), labels.repartition(1))
    assert (weights == again).all()
    got = {r.doc_id: r.predicted for r in quality.score(docs, weights).collect()}
    assert all(got[i] == i % 2 for i in range(80))


def test_training_and_scores_equal_the_definition(spark):
    """Update by update and coordinate by coordinate, with dictionaries."""
    rng, settings = np.random.default_rng(4), quality.Settings(alpha=0.7, beta=0.5, l1=0.02, l2=0.1)
    rows = [(i, " ".join(rng.choice(["good", "bad", "ok", "!", "a1"], rng.integers(0, 9)))) for i in range(40)]
    docs = frames.documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int")
    places = {r[0]: r[1] for r in labels.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    got = quality.train(docs, labels, bits=8, epochs=3, settings=settings)
    vectors = {}
    for key, text in rows:
        row, index, value = quality.Features(8)(*texts.flat(pa.array([text])))
        vectors[key] = dict(zip(index.tolist(), value.astype(np.float32).astype(float).tolist())) | {256: 1.0}
    z, n = dict.fromkeys(range(257), 0.0), dict.fromkeys(range(257), 0.0)

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        return (math.copysign(settings.l1, z[i]) - z[i]) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    for _ in range(3):
        for key in sorted(vectors, key=places.get):
            w = {i: weight(i) for i in vectors[key]}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in vectors[key].items())))
            for i, x in vectors[key].items():
                g = (p - (key % 3 == 0)) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / settings.alpha * w[i]
                n[i] += g * g
    assert got == pytest.approx([weight(i) for i in range(257)], abs=1e-9)
    for r in quality.score(docs, got).collect():
        dot = sum(got[i] * x for i, x in vectors[r.doc_id].items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-6)


def test_features_of_a_long_text_are_bounded_in_training(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_TEXT", 5)
    text = " ".join(f"w{i}" for i in range(500))
    docs = frames.documents(spark, [(1, text), (2, "short text")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    assert 0 < (weights[:-1] != 0).sum() <= 5 + 3


def test_messy_rows(spark, learned):
    docs = frames.documents(spark)
    got = frames.by_id(quality.score(docs, learned[2]))
    assert sum(map(len, got.values())) == len(frames.TEXTS)
    assert got[2][0]["score"] == got[3][0]["score"] == got[4][0]["score"] and got[1][0] == got[1][1]
    kept = quality.keep_good(docs, learned[2])
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for rows in got.values() for r in rows)


def test_empty_tables(spark):
    weights = quality.train(frames.empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert not weights.any()
    assert quality.score(frames.empty(spark), weights).collect() == []
    assert {r.score for r in quality.score(frames.documents(spark), weights).collect()} == {0.5}
