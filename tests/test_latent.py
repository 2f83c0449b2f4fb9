import hashlib

import numpy as np
import pyarrow as pa
import pytest

from reviewmill.operators import latent, search


def dense(lists, weights):
    rows = np.zeros((len(lists), len(weights)))
    for i, terms in enumerate(lists):
        for t in terms or ():
            rows[i, t] += weights[t]
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def topics(n=240, seed=3):
    """Texts of four topics; a text has few words of its topic, so two of them often share none."""
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"topic{i % 4}word{w}" for w in rng.choice(30, 6, False))) for i in range(n)]


def test_singular_values_equal_numpy(spark):
    rows = [*topics(), (900, None), (901, ""), (902, "alone")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    lists = latent.term_lists(df, 256)
    model = latent.fit(lists, 256, width=8, extra=24, rounds=12)
    plain = [r["terms"] for r in lists.collect()]
    with_term = np.bincount([t for terms in plain for t in set(terms)], minlength=256)
    assert model.weights == pytest.approx(np.log((len(rows) + 1) / (with_term + 1)))
    whole = np.linalg.svd(dense(plain, model.weights), full_matrices=False)
    assert model.values == pytest.approx(whole[1][:8], rel=1e-5)
    assert np.abs(model.directions[:, :4].T @ whole[2][:4].T).max(1) == pytest.approx(np.ones(4), abs=1e-3)


def test_topics_are_nearer_than_with_hashed_words(spark):
    df = spark.createDataFrame(topics(), "id long, text string").repartition(4)
    near = {}
    for name, found in (("words", search.text_vectors(df, 1024, "float64")), ("latent", latent.latent_vectors(df, terms=1024, width=8))):
        vectors = np.array([r["vec"] for r in found.orderBy("id").collect()])
        cosine, same = vectors @ vectors.T, np.equal.outer(np.arange(240) % 4, np.arange(240) % 4) & ~np.eye(240, dtype=bool)
        near[name] = cosine[same].mean() - cosine[~same & ~np.eye(240, dtype=bool)].mean()
    assert near["latent"] > 0.7 > 0.5 > near["words"]


def test_lengths_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "battery died"), (2, None), (3, "battery fine")], "id long, text string")
    got = {r["id"]: np.linalg.norm(r["vec"]) for r in latent.latent_vectors(df, terms=64, width=4).collect()}
    assert got == {1: pytest.approx(1), 2: 0, 3: pytest.approx(1)}
    assert latent.latent_vectors(df.limit(0), terms=64, width=4).collect() == []


def test_products_by_blocks_equal_numpy(monkeypatch):
    rng = np.random.default_rng(6)
    lists = [None if i % 9 == 0 else rng.integers(0, 50, rng.integers(0, 30)).tolist() for i in range(103)]
    weights, basis = rng.random(50) + 0.1, rng.normal(size=(50, 7))
    for block in (1, 64, 500, 1 << 20):
        monkeypatch.setattr(latent, "BLOCK", block)
        rows, total, whole = latent.Rows(pa.array(lists, pa.list_(pa.int32())), weights), np.ones((50, 7)), dense(lists, weights)
        rows.add_gram_times(basis, total)
        assert rows.times(basis) == pytest.approx(whole @ basis) and total == pytest.approx(1 + whole.T @ (whole @ basis))


def test_texts_are_stored_as_packed_counts(spark):
    texts = ["battery " * 300 + "died", "Battery died", None, "", "'", "battery " * 255]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    for terms, size in ((4096, 2), (1 << 17, 4)):
        stored = latent.term_counts(df, terms)
        place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % terms
        rows = {r["id"]: r["terms"] for r in stored.collect()}
        assert [len(rows[i]["places"]) for i in range(6)] == [2 * size, 2 * size, 0, 0, 0, size]
        assert [len(rows[i]["counts"]) for i in range(6)] == [2, 2, 0, 0, 0, 1] and len(rows[0]["many"]) == 4 == len(rows[5]["many"])
        listed = {r["id"]: r["terms"] for r in latent.term_lists(df, terms).collect()}
        words = [[w for w in (t or "").lower().split() if w != "'"] for t in texts]
        assert listed == {i: sorted(map(place, found)) for i, found in enumerate(words)}
        column = pa.array([dict(rows[i].asDict()) for i in range(6)], pa.struct([(x, pa.binary()) for x in ("places", "counts", "many")]))
        for part, low in ((column, 0), (column.slice(1, 4), 1), (column.slice(4), 4), (column.slice(6), 6)):
            row, term, count = latent.entries(part, terms)
            found = [np.repeat(term[row == i], count[row == i]).tolist() for i in range(len(part))]
            assert found == [listed[i] for i in range(low, low + len(part))]


def test_packed_counts_and_lists_give_the_same_fit(spark):
    df = spark.createDataFrame([*topics(60), (900, None)], "id long, text string").repartition(3)
    packed, lists = (latent.fit(x(df, 64), 64, width=4, extra=8, rounds=3) for x in (latent.term_counts, latent.term_lists))
    assert packed.weights == pytest.approx(lists.weights) and packed.values == pytest.approx(lists.values)
    assert packed.directions == pytest.approx(lists.directions, abs=1e-4)


def test_rounds_multiply_in_single_precision_and_add_up_in_double():
    rng = np.random.default_rng(8)
    lists = [rng.integers(0, 90, rng.integers(0, 60)).tolist() for _ in range(300)]
    weights, basis = rng.random(90) + 0.1, np.linalg.qr(rng.normal(size=(90, 6)))[0].astype(np.float32)
    rows, total, whole = latent.Rows(pa.array(lists, pa.list_(pa.int32())), weights), np.zeros((90, 6)), dense(lists, weights)
    assert {full.dtype for _, _, full in rows.blocks(basis.dtype)} == {np.dtype("float32")} and rows.times(basis).dtype == np.float32
    rows.add_gram_times(basis, total)
    assert total == pytest.approx(whole.T @ (whole @ basis), abs=1e-4)
