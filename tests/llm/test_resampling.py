import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reviewmill.llm import resampling
from reviewmill.llm.texts import flat
from tests.llm import frames

TARGET = [("the quick brown fox and the lazy dog jumps",), (None,), ("Released under a license!",)]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def features_of(text, longest=2):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, buckets=10_000, longest=2, least=20, percent=25, seed=7):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, text in rows for f in features_of(text, longest))
    t = Counter(place(f) for (text,) in target for f in features_of(text, longest))
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))

    found = []
    for key, text in rows:
        features = features_of(text, longest)
        weight = sum(gain(place(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([key, len(words_of(text)), len(features), weight, score, None])
    able = sorted((f for f in found if f[1] >= least), key=lambda f: (-f[4], f[0] is None, f[0]))
    for rank, f in enumerate(able[: len(able) * percent // 100], 1):
        f[5] = rank
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("options", [{}, {"buckets": 97, "longest": 3, "least_words": 1, "percent": 60, "seed": 1}])
def test_equals_counting(spark, options):
    rows = [*frames.TEXTS, *((20 + i, f"a row of words {i} " * (i % 9)) for i in range(60)), (90, "w" * 5000 + " x")]
    names = {"least_words": "least"}
    target = spark.createDataFrame(TARGET, "text string")
    got = resampling.resample(frames.documents(spark, rows), target, **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    wanted = brute(rows, TARGET, **{names.get(k, k): v for k, v in options.items()})
    same = lambda found: sorted(((r[:5], r[5] is None) for r in found), key=repr)
    got = [tuple(r) for r in got.collect()]
    assert same(got) == same(wanted) and sorted(r[5] for r in got if r[5]) == sorted(r[5] for r in wanted if r[5])


def test_equal_rows_have_ranks_of_their_own(spark):
    rows = [(1, "one two three")] * 50 + [(i, "four five six seven") for i in range(2, 40)] + [(None, "eight nine ten")] * 11
    docs = frames.documents(spark, rows)
    got = resampling.resample(docs, docs, least_words=3, percent=100).collect()
    ordered = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in ordered] == list(range(1, len(rows) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ordered] == sorted(
        (-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got
    )


def test_empty_tables(spark):
    empty, docs = frames.empty(spark), frames.documents(spark)
    assert resampling.resample(empty, docs).collect() == []
    assert {tuple(r) for r in resampling.resample(docs, empty.select("text")).collect()} == set(brute(frames.TEXTS, []))


def test_checksums_of_all_lengths():
    rng = np.random.default_rng(5)
    look, line = resampling.Buckets(), rng.integers(0, 256, 4000).astype(np.uint8)
    starts = np.concatenate([rng.integers(0, 900, 500), [3, 3, 3, 0]])
    ends = np.concatenate([starts[:500] + rng.integers(0, 40, 500), [3, 11, 11, 3999]])
    wanted = [zlib.crc32(line[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
    assert look.crcs(line, starts, ends).tolist() == wanted


def test_windows_of_words_do_not_change_features(spark, monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b c d e f g", None, "", "h", "i,j;k Ä ß9", "x" * 700 + " y"])
    whole = [np.concatenate(x) for x in list(zip(*resampling.Buckets()(*flat(texts))))[:2]]
    monkeypatch.setattr(resampling, "WINDOW_WORDS", 2)
    parts = list(resampling.Buckets()(*flat(texts)))
    cut = [np.concatenate(x) for x in list(zip(*parts))[:2]]
    assert sorted(zip(*map(np.ndarray.tolist, whole))) == sorted(zip(*map(np.ndarray.tolist, cut)))
    assert sum(sizes for _, _, sizes in parts).tolist() == [7, 0, 0, 1, 5, 2]
