import hashlib

from reviewmill.llm import exact_dedup
from tests.llm import frames


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    found = []
    for key, text in rows:
        keys = groups[text or ""]
        best = max((k for k in keys if k is not None), default=None)
        found.append((key, best, len(keys), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(found, key=repr)


def check(spark, rows, **options):
    got = exact_dedup.exact_duplicates(frames.documents(spark, rows), **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_messy_rows(spark):
    check(spark, frames.TEXTS)


def test_heavy_and_rare_groups(spark):
    rows = [(i, f"text {min(i % 50, 12)}") for i in range(400)]
    check(spark, rows, heavy=4)


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(frames.empty(spark)).collect() == []


def test_rows_without_copies(spark):
    docs = frames.documents(spark)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in frames.TEXTS})


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.exact_duplicates(frames.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
