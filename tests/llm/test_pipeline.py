import os
import subprocess
import sys

import pytest

import corpus_pipeline
from reviewmill.llm import language, quality, registry
from reviewmill.session import settle, shared_dir
from reviewmill.streaming.ingest import names_below
from tests import oracle
from tests.llm import frames
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check_layout, expected_pieces

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r for r in language.identify(docs, registry.language_trees(spark, SF)).collect()}
    good = {r.doc_id: r for r in quality.score(docs, registry.quality_weights(spark, SF)).collect()}
    rows = [
        (r.doc_id, r.text) for r in docs.collect()
        if known[r.doc_id].lang_pred != "und" and good[r.doc_id].predicted
    ]
    last = {text: max(k for k, t in rows if t == text) for _, text in rows}
    rows = [(k, t) for k, t in rows if last[t] == k]
    groups = brute(rows)
    rows = [(k, t) for k, t in rows if groups[k][2] == k]
    folder = f"{shared_dir(spark)}/reviewmill"
    there = set(names_below(spark, folder))
    got = corpus_pipeline.run(spark, SF).collect()
    assert [name.rsplit("-", 1)[0] for name in set(names_below(spark, folder)) - there] == ["stage-packing"]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected_pieces(rows)
    check_layout(got, 2048)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema


@pytest.mark.parametrize("rows", [frames.TEXTS, []])
def test_stages_in_turn_on_messy_and_empty_tables(spark, rows):
    """Nulls, empty and long texts, repeated rows and ids on several texts go through all stages."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(key, text, None, None, None) for key, text in rows], kinds)
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, docs, SF), "messy")
        if name != "packing":
            assert after.columns == docs.columns and not after.exceptAll(docs).count()
        docs = after
    assert rows or not docs.count()
    assert not {r.doc_id for r in docs.collect()} & {2, 3, 4, 9}  # texts without a letter have no language


@pytest.mark.parametrize("name", sorted(registry.CHECKS))
def test_query_equals_its_check(spark, name):
    assert oracle.differences(spark, oracle.connect(SF), name, SF) == []


def test_queries_run_from_another_folder(tmp_path):
    """Workers must not need the package on their path."""
    code = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "import __spark_entry__ as entry\n"
        "from reviewmill.session import build_session\n"
        "spark = build_session('local[2]', 2, spark__ui__enabled='false')\n"
        "for name in ('op6_quality_classifier', 'op7_license_scan', 'op8_language_id'):\n"
        f"    assert entry.queries()[name](spark, {SF!r}).count() == 200\n"
    )
    settings = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=settings, check=True, timeout=600)
