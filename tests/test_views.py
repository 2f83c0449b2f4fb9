"""Texts in the tables that queries are made from."""

from reviewmill.plans import driver_views, registry
from reviewmill.plans.driver_views import Tables

SF = "/root/testdata/sf0.001"


def test_vectors_meet_events_before_texts(spark):
    plan = Tables(spark, SF).vectors._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "Relation" in line]
    assert ["event_id" in read[0], "embedding" in read[1], "text" in read[2]] == [True] * 3


def test_a_model_reads_stored_style_features(spark):
    plan = registry.QUERIES["ml06_helpfulness_model"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "avg_word_length" in plan and "doc_text" not in plan and "documents" not in plan


def test_ingested_texts_are_not_shuffled(spark):
    plan = registry.QUERIES["stm01_stream_ingest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_arrays_of_phrases_store_and_shuffle_no_reviews(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(driver_views, "_settled", {})
    monkeypatch.setattr(driver_views, "settle", lambda df, name: stored.append(name) or df)
    plan = registry.QUERIES["arr01_arrays"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # documents and events meet by their keys; what is made of them goes nowhere
    assert stored == [] and plan.count("RepartitionByExpression") == 2 and plan.index("Join") < plan.index("RepartitionByExpression")
