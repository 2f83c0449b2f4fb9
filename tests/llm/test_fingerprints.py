import hashlib
from collections import Counter

import numpy as np
import pytest

from reviewmill.llm import fingerprints
from tests.llm import frames


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("parts", [1, 7])
def test_every_row_meets_the_next(spark, parts, monkeypatch):
    rows = [(i, f"text number {i} with some more words " * (i % 5)) for i in range(40)]
    rows += [(100, frames.LONG), (101, "x"), (102, None), (103, "日本語 ça"), (None, "no id at all")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(frames.documents(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered, sampler = in_order(rows), fingerprints.Sampler()
    assert len(got) == len(rows)
    for (key, text), (following, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after, row = text or "", after or "", got[key]
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, new, beside = sampler([text, changed, after])
        assert row["fingerprint"] == own.astype(">u2").tobytes().hex() and row["edited_fingerprint"] == new.astype(">u2").tobytes().hex()
        assert row["near_edited"] == (own == new).mean() and row["near_next"] == (own == beside).mean()
        shown = [np.frombuffer(bytes.fromhex(got[k]["fingerprint"]), ">u2") for k in (key, following)]
        assert row["near_next"] == (shown[0] == shown[1]).mean()


def test_repeated_rows_and_empty_tables(spark):
    found = fingerprints.fingerprints(frames.documents(spark))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = found.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(key for key, _ in frames.TEXTS)
    fox = "The quick brown fox jumps over the lazy dog, again and again."
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == len(fox) and r["doc_id"] in (1, 6)}) == 1
    assert fingerprints.fingerprints(frames.empty(spark)).collect() == []
    single = fingerprints.fingerprints(frames.documents(spark, [(5, "a single row")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in single] == [(5, 1.0)]


def test_equal_samples_are_as_many_as_the_weighted_likeness():
    rng = np.random.default_rng(2)
    sampler = fingerprints.Sampler(samples=4000)
    for size, names in ((200, 5), (60, 30), (400, 3)):
        a = [f"w{i}" for i in rng.integers(0, names, size)]
        b = a[: size // 2] + [f"w{i}" for i in rng.integers(0, names, size // 2)]
        x, y = (Counter(zip(t, t[1:])) for t in (a, b))
        wanted = sum((x & y).values()) / sum((x | y).values())
        one, two = sampler([" ".join(a), " ".join(b)])
        assert (one == two).mean() == pytest.approx(wanted, abs=0.035)


def test_samples_do_not_depend_on_the_company():
    texts = [t or "" for _, t in frames.TEXTS] + ["one", "one one", "one two one two one"]
    sampler = fingerprints.Sampler()
    together = sampler(texts)
    assert all((sampler([t])[0] == row).all() for t, row in zip(texts, together))
    assert not sampler(["", " \n"]).any() and (sampler(["a", "!"]) > 0).all()
    assert len(set(sampler(["a"])[0].tolist())) > 60  # chance meetings of two terms differ from sample to sample


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = fingerprints.Sampler()([text, "a b c"])
    monkeypatch.setattr(fingerprints, "WINDOW_BYTES", 64)
    assert (fingerprints.Sampler()([text, "a b c"]) == whole).all()
