import random

import numpy as np
import pytest

from reviewmill.llm import vectors
from tests.llm import frames


def brute(rows, threshold=0.95):
    usable = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[key] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = {key: {k for k, w in usable.items() if k != key and len(w) == len(usable[key]) and w @ usable[key] >= threshold} for key in usable}
    found = {}
    for key, _ in rows:
        reach, todo = {key}, [key]
        while todo:
            new = links.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        found[key] = (len(links.get(key, ())), min(reach) if key is not None else None)
    return found


def clusters(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[i % 6] + rng.normal(size=dim) * (0.05 + 0.25 * (i % 4) / 3)).astype(np.float32).tolist()) for i in range(n)]


MESSY = [
    (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
    (7, [None, 1.0]), (8, [2.0, 0.01]), (9, [1.0, 0.0, 0.0]), (10, [1e30, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0]),
]


def near_threshold(seed, n, dim):
    """Vectors around one direction whose cosines lie within the error of the codes around 0.95, and copies of some."""
    rng = np.random.default_rng(seed)
    rows = [(np.eye(dim)[0] + 0.2294 * x / np.linalg.norm(x)).tolist() for x in np.concatenate([np.zeros((n, 1)), rng.normal(size=(n, dim - 1))], 1)]
    return [(i, v) for i, v in enumerate(rows + rows[:10])]


CASES = [(clusters(1, 150, 16), 1 << 19), (clusters(2, 150, 16), 320), (MESSY, 1 << 19), (MESSY, 4), (near_threshold(3, 60, 40), 500), (clusters(4, 40, 1536), 15_000)]


@pytest.mark.parametrize("rows, components", CASES)
def test_equals_all_pairs(spark, rows, components):
    table = frames.with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = frames.by_id(vectors.near_duplicates(table, least_components=components), "vec_id")
    assert sum(map(len, got.values())) == len(rows)
    for key, (n, component) in brute(rows).items():
        for row in got[key]:
            assert (row["n_links"], row["component_id"]) == (n, component) and row["kept"] == (component == key)


def test_empty_table(spark):
    table = frames.with_clashes(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert vectors.near_duplicates(table).collect() == []


def test_bound_holds():
    rng = random.Random(1)
    raw = np.array([[rng.gauss(0, 1) * rng.choice([1, 1, 30]) for _ in range(24)] for _ in range(40)])
    unit = vectors.units(raw)
    x = vectors.Codes(np.arange(40), unit)
    near = vectors.products(x.q, x.q) * np.outer(x.scale, x.scale)
    assert (np.abs(unit @ unit.T - near) <= np.outer(x.u, x.u) - np.outer(x.a, x.a) + 1e-9).all()


def test_products_are_exact_for_many_components():
    rng = np.random.default_rng(2)
    q = rng.choice(np.array([-127, 126, 127], np.int8), (6, 5000))
    assert (vectors.products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()


def test_codes_and_full_vectors_agree_on_every_pair():
    """A pair is decided by the codes or left to the full vectors, in whatever company it is coded."""
    rows = near_threshold(5, 80, 64)
    ids, unit = np.arange(len(rows)), vectors.units(np.array([v for _, v in rows]))
    whole = vectors.Codes(ids, unit)
    sure, left = set(), set()
    for i, j, yes in vectors.tiles(whole, whole, True, 0.95):
        sure |= set(zip(i[yes].tolist(), j[yes].tolist()))
        left |= set(zip(i[~yes].tolist(), j[~yes].tolist()))
    some = np.array(sorted({k for pair in left for k in pair}))
    part = vectors.Codes(some, unit[some])
    again = {(int(some[a]), int(some[b])) for i, j, yes in vectors.tiles(part, part, True, 0.95) for a, b, y in zip(i, j, yes) if not y}
    assert len(left) > 50 and len(sure) >= 10 and again == left
    wanted = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if unit[i] @ unit[j] >= 0.95}
    assert sure <= wanted <= sure | left


def test_only_codes_travel_to_all_blocks():
    unit = vectors.units(np.random.default_rng(1).normal(size=(100, 384)))
    row = vectors.Codes(np.arange(100), unit).to_row()
    assert sum(map(len, row.values())) < unit.nbytes / 7
