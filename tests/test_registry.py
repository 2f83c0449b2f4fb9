import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from reviewmill.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def check_plan(name, df):
    """Neither cross joins nor rows handed to Python one by one, and Python in the queries named only."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan), name
    if not name.startswith(("ml14", "mcl09", "ml13_batch", "ml13_index", "ml12_latent", "ml03_autoencoder")):
        assert "Python" not in plan and "MapInPandas" not in plan, name


@pytest.mark.parametrize("name", sorted(registry.CHECKS))
def test_query_equals_its_check(spark, con, name):
    assert oracle.differences(spark, con, name, SF, lambda df: check_plan(name, df)) == []


def test_every_query_has_a_check():
    assert set(registry.QUERIES) == set(registry.CHECKS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_python_queries_run_from_another_folder(tmp_path):
    """Workers must not need the package on their path."""
    code = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "import __spark_entry__ as entry\n"
        "from reviewmill.session import build_session\n"
        "spark = build_session('local[2]', 2, spark__ui__enabled='false')\n"
        "for name in ('ml14_ab_significance', 'mcl09_run_client', 'ml13_batch_search'):\n"
        f"    assert entry.queries()[name](spark, {SF!r}).count() > 0\n"
    )
    settings = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=settings, check=True, timeout=600)


@pytest.mark.parametrize("missing", ["zstandard", "tiktoken", "regex", "ahocorasick", "public_tokenizers", "reviewmill.llm", "corpus_pipeline"])
def test_other_queries_do_without_a_library_of_the_training_data_part(missing):
    code = (
        f"import sys; sys.path.insert(0, {REPO!r}); sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as entry\n"
        f"assert len(entry.queries()) == {len(registry.QUERIES)} and len(entry.oracle_sql()) == {len(registry.CHECKS)}\n"
    )
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, timeout=120)
