"""Components of words by a scan: the same as by the native pattern, and stored without the texts."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.functions import phrases as scans
from reviewmill.functions import text as tx
from reviewmill.operators import search

SIGNS = [*"ab'_'- .1Zé", "ß", "İ", "K", "中", "𝒳", "𝟘", "²", "Ⅷ", "́", "\U0002ebf0", "'''", "ſ", "ǅ", " ", "\n"]
ODD = ["", None, "'", "''", "'a", "a'", "'ab", "a", "_", "__", "é", "é'", "éa", "'é'", "don't 'tis o'", "中文 中", "x" * 70_000]


def test_scanned_places_equal_the_pattern(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices(SIGNS, k=rng.randrange(40))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({tx.WORD})"), F.lit(1))
    rows = df.select("id", words.alias("words"), tx.word_places(spark, F.col("text"), 384).alias("tf")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 384 for w in row["words"])
        assert dict(zip(row["tf"].indices.tolist(), row["tf"].values.tolist())) == want


def test_words_do_not_run_over_windows_or_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scans.WordPlaces, "KNOWN", 3)
    texts = pa.array(["alpha beta", "gamma", None, "", "alpha'", "'beta gamma", "delta epsilon zeta"] * 5)
    count = scans.word_counts(64, np.zeros(0, np.int64))
    whole = count(texts).to_pylist()
    monkeypatch.setattr(scans.WordPlaces, "BYTES", 12)
    assert count(texts).to_pylist() == whole and [sum(r["values"]) for r in whole[:7]] == [2, 1, 0, 0, 1, 2, 3]
    assert count(texts.slice(4, 3)).to_pylist() == whole[4:7] and len(count(texts.slice(0, 0))) == 0


def test_text_vectors_store_components_without_whole_texts(spark):
    texts = ["alpha beta beta", "beta gamma", "", None, "alpha " * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").withColumn("text", F.substring("body", 1, 3))
    found = search.text_vectors(df, precision="float64", whole="body")
    assert found.columns == ["id", "text", "vec"]
    stored = spark.read.parquet(*found.inputFiles())
    assert stored.columns == ["id", "text", "_tf"]
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % search.DIMENSIONS
    words = [Counter(place(w) for w in (t or "").split()) for t in texts]
    seen = Counter(p for c in words for p in c)
    for row in found.collect():
        weights = {p: n * math.log((len(texts) + 1) / (seen[p] + 1)) for p, n in words[row["id"]].items()}
        length = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        assert row["vec"] == pytest.approx([weights.get(i, 0.0) / length for i in range(search.DIMENSIONS)])
        assert row["text"] == (texts[row["id"]][:3] if texts[row["id"]] is not None else None)


def test_words_that_share_a_slot_keep_their_places(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    words = ["".join(rng.choices("ab_é", k=rng.randrange(2, 20))) for _ in range(80)] + ["a" * n for n in range(2, 20)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(60)]
    monkeypatch.setattr(scans.WordPlaces, "BYTES", 300)
    for slots in (1, 7, 1 << 20):
        monkeypatch.setattr(scans.WordPlaces, "SLOTS", slots)
        found = scans.word_counts(512, np.array([0xE9]))(pa.array(texts)).to_pylist()
        for text, got in zip(texts, found):
            want = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 512 for w in text.split())
            assert dict(zip(got["indices"], got["values"])) == want
