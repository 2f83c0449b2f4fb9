import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from reviewmill.llm import collocations
from tests.llm import frames


def brute(rows, longest=5, least=100, share=100, top=2000):
    found, sizes = Counter(), Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            found.update((lang or "und", *words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    candidates = {p: f for p, f in found.items() if len(p) > 2 and f >= least}
    dropped = set()
    for p, f in candidates.items():
        for n in range(2, len(p) - 1):
            for i in range(1, len(p) - n + 1):
                inner = (p[0], *p[i : i + n])
                if 100 * f >= share * candidates[inner]:
                    dropped.add(inner)
    result = {}
    for p, a in candidates.items():
        if p in dropped:
            continue
        lang, words, n = p[0], p[1:], sizes[p[0]]
        cuts = []
        for k in range(1, len(words)):
            l, r = found[(lang, *words[:k])], found[(lang, *words[k:])]
            cuts.append((Fraction(1000 * a * n, l * r).__floor__(), k, l, r))
        score, _, l, r = min(cuts)
        result.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r, n))
    return sorted(
        (lang, i, phrase.decode(), -a, l, r, n, -score)
        for lang, rows in result.items() for i, (score, a, phrase, l, r, n) in enumerate(sorted(rows)[:top], 1)
    )


def rows_of(seed=3, n=160):
    rng = np.random.default_rng(seed)
    names = ["of", "the", "new", "York", "état", "日本", "x'y", "-"]
    rows = [(["en", "fr", None][i % 3], " ".join(rng.choice(names, rng.integers(0, 40)))) for i in range(n)]
    return rows + [("en", "New York, of\tthe new;of the\nnew york state. " * 9), ("fr", None), (None, ""), ("en", ",;\n"), ("de", "word " * 300)]


ROUTES = [
    {},
    {"ranked": 3, "part_words": 50, "entries": 40, "burst": 2},
    {"ranked": 0, "part_words": 500, "entries": 10, "burst": 1},
    {"part_words": 10, "entries": 100, "burst": 4},
]


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("options", [{"least": 12}, {"least": 4, "longest": 3, "share": 60, "top": 7}])
def test_equals_counting(spark, route, options):
    rows = rows_of()
    docs = frames.with_clashes(spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumnRenamed("lang", "language"))
    got = collocations.collocations(docs, lang="language", **options, **route)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, **options)


def test_frames_and_empty_tables(spark):
    rows = [(None, text) for _, text in frames.TEXTS]
    docs = frames.documents(spark).drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert sorted(map(tuple, collocations.collocations(docs, least=2).collect())) == brute(rows, least=2)
    assert collocations.collocations(docs, least=10**9).collect() == []
    assert collocations.collocations(frames.empty(spark)).collect() == []


def test_trie_bursts_and_spills():
    rng = np.random.default_rng(1)
    rows = np.zeros((3000, 5), np.int64)
    rows[:, :3] = rng.integers(1, 9, (3000, 3))
    rows[:, 3] = -rng.integers(1, 5, 3000)
    trie, wanted = collocations.HatTrie(burst=5), Counter(map(tuple, rows.tolist()))
    seen = Counter()
    for part in np.split(rows, 10):
        trie.add(*collocations.distinct(part))
        found, counts = trie.spill(200)
        seen.update(dict(zip(map(tuple, found.tolist()), counts.tolist())))
        assert trie.entries <= 200
    found, counts = trie.spill(0)
    assert trie.entries == 0 and trie.root == {}
    for phrase, n in zip(map(tuple, found.tolist()), counts.tolist()):
        seen[phrase] += n
    assert seen == wanted


def test_runs_round_trip():
    rows = np.array([[1, 2, 0, 0, 0], [1, 2, -(1 << 63), 4, 5], [9, -3, 1, 0, 0]], np.int64)
    for low, high in ((0, 3), (1, 2), (0, 0)):
        back, counts = collocations.unpack_run(collocations.pack_run(rows[low:high], np.arange(low, high)), 5)
        assert (back == rows[low:high]).all() and counts.tolist() == list(range(low, high))


def test_prefix_decides_the_partition():
    hot = 2  # numbers 1 and 2 are very frequent
    rows = np.array([[1, 2, 1, 7, 8], [1, 2, 1, 7, 9], [1, 2, 1, 6, 8], [5, 1, 1, 1, 1], [5, 1, 2, 2, 2], [5, 2, 0, 0, 0]], np.int64)
    part = collocations.partition_of(rows, 1 << 20, hot).tolist()
    assert part[0] == part[1] != part[2] and part[3] == part[4] != part[5]


@pytest.mark.parametrize("text", ["New York, new york; the " * 500, "one piece without an end " * 300, "a.b;" * 900 + "tail", ",.;" * 400])
def test_long_rows_are_cut_after_pieces(spark, monkeypatch, text):
    words = collocations.Words()
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr", None], "text": ["short row", text, None]})
    whole = [w for data, offsets, _ in collocations.windows_of(batch, words) for w in words(data, offsets, np.zeros(len(offsets) - 1, np.uint64))[2].tolist()]
    monkeypatch.setattr(collocations, "WINDOW_BYTES", 1000)
    parts = list(collocations.windows_of(batch, words))
    assert [w for data, offsets, _ in parts for w in words(data, offsets, np.zeros(len(offsets) - 1, np.uint64))[2].tolist()] == whole
    assert b"".join(data.tobytes() for data, _, _ in parts) == ("short row" + text).lower().encode()
    assert all(len(data) <= 2000 for data, _, _ in parts) or "without" in text
    rows = [("en", text), ("en", "short row")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=50).collect())) == brute(rows, least=50)
