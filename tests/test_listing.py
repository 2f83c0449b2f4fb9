import pytest
from pyspark.sql import functions as F

from reviewmill.operators import joins, listing

ENTITIES = "array<struct<entity:string,n:bigint>>"


def audited(spark, text, components, issues):
    df = spark.createDataFrame([(text, components, issues)], f"t string, c {ENTITIES}, i {ENTITIES}")
    found = df.withColumn("mismatches", listing.mismatches(F.col("t"), F.col("c"), F.col("i")))
    return listing.decide(found.withColumn("audit_summary", listing.audit_summary(F.col("mismatches")))).first()


def test_mismatch_limits(spark):
    row = audited(spark, "Long BATTERY life, usb", [("battery", 20), ("usb", 5), ("fan", 50)],
                  [("a", 30), ("b", 15), ("c", 10), ("d", 9)])
    assert [(m["severity"]) for m in row["mismatches"]] == ["high", "medium", "high", "medium", "low"]
    assert row["mismatches"][0].asDict() == {
        "claim": "Listing mentions 'battery'", "complaint": "20 reviews mention 'battery' in complaints", "severity": "high"}
    assert row["mismatches"][2].asDict() == {
        "claim": "Listing does not address", "complaint": "'a' mentioned in 30 reviews", "severity": "high"}
    assert row["audit_summary"] == "Found 5 mismatches: 2 high, 2 medium, 1 low."
    assert (row["final_status"], row["supervisor_notes"]) == ("needs_review", "High severity mismatch detected — requires human review")


@pytest.mark.parametrize("issues, status, notes", [
    ([], "approved", "All mismatches are low severity — auto-approved"),
    ([("a", 10)], "approved", "All mismatches are low severity — auto-approved"),
    ([("a", 15)], "approved", "Changes look reasonable"),
    ([(c, 10) for c in "abcdef"], "needs_review", "Too many changes, needs human review"),
])
def test_decision_rules(spark, issues, status, notes):
    row = audited(spark, "", [], issues)
    assert (row["final_status"], row["supervisor_notes"]) == (status, notes)


def test_unchanged_listing_is_approved(spark):
    df = spark.sql("SELECT array(named_struct('severity', 'high')) AS mismatches, 'no_changes_needed' AS status")
    row = listing.decide(df, F.col("status")).first()
    assert (row["final_status"], row["supervisor_notes"]) == ("approved", "No issues found")


REVIEWS = "id long, asin string, parent_asin string, rating double, title string, text string"
PRODUCTS = "parent_asin string, title string, description string, features string, price string, rating_number int"


def test_profiles_and_lookup(spark):
    reviews = spark.createDataFrame(
        [(1, "a", "p", 1.0, "Battery", "died"), (2, "a", "q", 4.0, None, None), (3, "b", "b", 2.0, "fan", "fan"), (4, None, "p", 1.0, "x", "y")],
        REVIEWS,
    )
    requested = spark.createDataFrame([("a",), ("zzz",)], "asin string")
    rows = {r["asin"]: r for r in listing.complaint_profiles(listing.product_entities(reviews), requested).collect()}
    assert set(rows) == {"a", "zzz"}
    assert rows["zzz"]["summary"] == "No reviews found." and rows["zzz"]["review_count"] == 0
    assert rows["a"]["summary"] == (
        "Product has 2 reviews (avg 2.50 stars, 50.0% negative).\nTop components:\n  - battery (1 mentions)\nTop issues:\n  - died (1 mentions)\n")
    products = spark.createDataFrame(
        [("p", "via parent", None, None, "1", 3), ("p", "older", None, None, "1", 1), ("b", "direct", "d", "f", "2", None), ("b", "direct", "d", "f", "2", None)],
        PRODUCTS,
    )
    rows = joins.with_listing(joins.review_parents(reviews), products).collect()
    found = {r["asin"]: r for r in rows}
    assert len(rows) == len(found)
    assert found["a"]["product_title"] == "via parent" and found["b"]["product_title"] == "direct"
    audit = {r["asin"]: r for r in listing.product_audit(listing.product_entities(reviews), products, requested=requested).collect()}
    assert audit["zzz"]["final_status"] == "approved" and audit["zzz"]["review_count"] == 0 and audit["a"]["rewritten_title"] is None


def test_ties_are_ordered_by_name(spark):
    df = spark.createDataFrame([([("z", 2), ("b", 2), ("a", 1), ("c", 9)],)], f"e {ENTITIES}")
    top = df.select(listing.most_common(F.col("e"), 3).alias("t")).first()["t"]
    assert [(x["entity"], x["n"]) for x in top] == [("c", 9), ("b", 2), ("z", 2)]
