import random
import re

import pytest

from reviewmill.llm import near_dedup
from tests.llm import frames


def gram_set(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {key: gram_set(text) for key, text in rows if key is not None}
    links = {key: set() for key in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a].add(b)
                links[b].add(a)
    found = {}
    for key in sets:
        reach, todo = {key}, [key]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        same = min(k for k in links[key] | {key} if sets[k] == sets[key]) if sets[key] else key
        found[key] = (same, len(links[key]), min(reach))
    return found


def variants(seed, groups, size, length, changes):
    rng, rows = random.Random(seed), []
    for group in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(changes)):
                copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(
    "rows, options",
    [
        (frames.TEXTS, {}),
        (variants(1, 6, 12, 120, 6) + variants(2, 1, 1, 4, 1)[:0], {}),
        (variants(3, 2, 40, 60, 3), {"bucket_rows": 8, "group_grams": 300}),  # many blocks
        ([(i, f"one two three {i % 3}") for i in range(9)], {}),
    ],
)
def test_equals_all_pairs(spark, rows, options):
    got = frames.by_id(near_dedup.near_duplicates(frames.documents(spark, rows), **options))
    for key, expected in brute(rows).items():
        for row in got[key]:
            assert (row["class_id"], row["n_links"], row["component_id"]) == expected
            assert row["kept"] == (expected[2] == key)
    for row in got.get(None, []):
        assert row["class_id"] is None and row["component_id"] is None and row["n_links"] == 0 and row["kept"]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(frames.empty(spark)).collect() == []


def test_kept_rows(spark):
    docs = frames.documents(spark)
    kept = near_dedup.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 1, 2, 3, 4, 5, 7, 8, 9]


def test_pruning_bound():
    assert near_dedup.least_equal(16, 0.8, 1e-6) < near_dedup.least_equal(128, 0.8, 1e-6) <= 128 * 0.8
    assert near_dedup.least_equal(128, 0.8, 0.5) > near_dedup.least_equal(128, 0.8, 1e-9)
