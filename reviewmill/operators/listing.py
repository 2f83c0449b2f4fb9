"""Complaint profiles, listing audits and approval decisions, for all products in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.operators import joins
from reviewmill.operators.product_features import entity_counts, entity_list, of_kind, rating_measures

TOP_ENTITIES = 10
MAX_AUTO_APPROVED = 5
# This text and those of summaries, claims, complaints, audits and notes below must match as output.
NO_REVIEWS = "No reviews found."


def product_entities(reviews: DataFrame) -> DataFrame:
    """Review count, ratings, fallback parent and sorted entity counts per asin. Titles count as text.

    The one pass over all texts; store the result, as profiles, rankings and audits are made from it.
    """
    known = reviews.filter(F.col("asin").isNotNull())
    counts = entity_counts(
        known,
        ["asin"],
        F.concat_ws(" ", "title", "text"),
        [F.col("rating"), F.col("parent_asin")],
        [*rating_measures(), F.min("parent_asin").alias("parent_asin")],
    )
    return counts.groupBy("asin").agg(
        of_kind("review", F.col("n"), "review_count"),
        of_kind("review", F.try_divide("rating_sum", "rating_count"), "mean_rating"),
        of_kind("review", F.col("negative_count") * 100 / F.col("n"), "negative_share"),
        of_kind("review", F.col("parent_asin"), "parent_asin"),
        entity_list("component").alias("components"),
        entity_list("issue").alias("issues"),
    )


def most_common(entities: Column, n: int = TOP_ENTITIES) -> Column:
    """The ``n`` entities with the largest counts, ties by name. The list holds one entry per dictionary phrase."""
    keyed = F.transform(entities, lambda e: F.struct((-e["n"]).alias("order"), e["entity"].alias("entity"), e["n"].alias("n")))
    return F.transform(
        F.slice(F.array_sort(keyed), 1, n), lambda e: F.struct(e["entity"].alias("entity"), e["n"].alias("n"))
    )


def top_entities(entities: DataFrame, n: int = TOP_ENTITIES) -> DataFrame:
    """Long form of ``product_entities``: asin, kind, entity, count, position."""
    ranked = entities.select(
        "asin",
        F.explode_outer(
            F.array(
                F.struct(F.lit("component").alias("kind"), most_common(F.col("components"), n).alias("top")),
                F.struct(F.lit("issue").alias("kind"), most_common(F.col("issues"), n).alias("top")),
            )
        ).alias("k"),
    )
    return ranked.select("asin", "k.kind", F.posexplode("k.top").alias("position", "e")).select(
        "asin", "kind", "e.entity", F.col("e.n").alias("mentions"), (F.col("position") + 1).alias("position")
    )


def complaint_profiles(entities: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Per asin of ``product_entities``: review count, mean rating, share of negatives, top components and issues, summary.

    ``requested`` (a table with ``asin``) limits the result; requested asins without reviews get an empty profile.
    """
    profiles = entities
    if requested is not None:
        profiles = requested.select("asin").distinct().join(profiles, "asin", "left")
    empty = F.array().cast("array<struct<entity:string,n:bigint>>")
    profiles = profiles.select(
        "asin",
        "parent_asin",
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.coalesce(F.col("mean_rating"), F.lit(0.0)).alias("mean_rating"),
        F.coalesce(F.col("negative_share"), F.lit(0.0)).alias("negative_share"),
        F.coalesce(most_common(F.col("components")), empty).alias("top_components"),
        F.coalesce(most_common(F.col("issues")), empty).alias("top_issues"),
    )
    return profiles.select(
        "asin",
        "parent_asin",
        "review_count",
        tx.exact_round(F.col("mean_rating"), 2).alias("avg_rating"),
        tx.exact_round(F.col("negative_share"), 1).alias("negative_pct"),
        "top_components",
        "top_issues",
        profile_summary().alias("summary"),
    )


def profile_summary() -> Column:
    def section(heading: str, top: str) -> Column:
        lines = F.transform(
            F.slice(top, 1, 5),
            lambda e: F.concat(F.lit("  - "), e["entity"], F.lit(" ("), e["n"].cast("string"), F.lit(" mentions)\n")),
        )
        return F.when(F.size(top) > 0, F.concat(F.lit(heading), F.array_join(lines, ""))).otherwise("")

    head = F.concat(
        F.lit("Product has "),
        F.col("review_count").cast("string"),
        F.lit(" reviews (avg "),
        tx.exact_decimal(F.col("mean_rating"), 2),
        F.lit(" stars, "),
        tx.exact_decimal(F.col("negative_share"), 1),
        F.lit("% negative).\n"),
    )
    body = F.concat(head, section("Top components:\n", "top_components"), section("Top issues:\n", "top_issues"))
    return F.when(F.col("review_count") == 0, NO_REVIEWS).otherwise(body)


def mismatches(listing: Column, components: Column, issues: Column) -> Column:
    """``array<struct<claim, complaint, severity>>`` from a listing text and the top entities.

    A component named in the listing counts from 5 mentions (high from 20), an issue from 10 (high from 30, medium
    from 15).
    """
    lowered = F.lower(listing)
    named = F.filter(components, lambda e: lowered.contains(e["entity"]) & (e["n"] >= 5))
    frequent = F.filter(issues, lambda e: e["n"] >= 10)
    from_components = F.transform(
        named,
        lambda e: F.struct(
            F.concat(F.lit("Listing mentions '"), e["entity"], F.lit("'")).alias("claim"),
            F.concat(e["n"].cast("string"), F.lit(" reviews mention '"), e["entity"], F.lit("' in complaints")).alias("complaint"),
            F.when(e["n"] >= 20, "high").otherwise("medium").alias("severity"),
        ),
    )
    from_issues = F.transform(
        frequent,
        lambda e: F.struct(
            F.lit("Listing does not address").alias("claim"),
            F.concat(F.lit("'"), e["entity"], F.lit("' mentioned in "), e["n"].cast("string"), F.lit(" reviews")).alias("complaint"),
            F.when(e["n"] >= 30, "high").when(e["n"] >= 15, "medium").otherwise("low").alias("severity"),
        ),
    )
    return F.concat(from_components, from_issues)


def severity_count(found: Column, severity: str) -> Column:
    return F.size(F.filter(found, lambda m: m["severity"] == severity))


def audit_summary(found: Column) -> Column:
    text = F.concat(
        F.lit("Found "), F.size(found).cast("string"), F.lit(" mismatches: "),
        severity_count(found, "high").cast("string"), F.lit(" high, "),
        severity_count(found, "medium").cast("string"), F.lit(" medium, "),
        severity_count(found, "low").cast("string"), F.lit(" low."),
    )
    return F.when(F.size(found) > 0, text).otherwise("No significant mismatches found.")


def audit(profiles: DataFrame, products: DataFrame) -> DataFrame:
    """Profiles with their product's listing, the mismatches and the audit sentence. Missing listings are empty."""
    listed = joins.with_listing(profiles, products)
    blank = {f"product_{c}": "" for c in ("title", "description", "features", "price")}
    listed = listed.withColumn("product_price", F.col("product_price").cast("string")).na.fill(blank)
    listing = F.concat_ws(" ", "product_title", "product_description", "product_features")
    found = listed.withColumn("mismatches", mismatches(listing, F.col("top_components"), F.col("top_issues")))
    return found.withColumn("audit_summary", audit_summary(F.col("mismatches"))).withColumn(
        "mismatch_count", F.size("mismatches")
    )


def needs_rewrite(audited: DataFrame) -> DataFrame:
    return audited.filter(F.size("mismatches") > 0)


def decide(audited: DataFrame, status: Column | None = None) -> DataFrame:
    """``final_status`` and ``supervisor_notes``; the first rule that holds decides."""
    found, count = F.col("mismatches"), F.size("mismatches")
    unchanged = F.lit(False) if status is None else F.coalesce(status == "no_changes_needed", F.lit(False))
    all_low = severity_count(found, "low") == count
    any_high = severity_count(found, "high") > 0
    final = (
        F.when(unchanged, "approved").when(count > MAX_AUTO_APPROVED, "needs_review").when(all_low, "approved")
        .when(any_high, "needs_review").otherwise("approved")
    )
    notes = (
        F.when(unchanged, "No issues found")
        .when(count > MAX_AUTO_APPROVED, "Too many changes, needs human review")
        .when(all_low, "All mismatches are low severity — auto-approved")
        .when(any_high, "High severity mismatch detected — requires human review")
        .otherwise("Changes look reasonable")
    )
    return audited.withColumn("final_status", final).withColumn("supervisor_notes", notes)


def product_audit(
    entities: DataFrame, products: DataFrame, rewrites: DataFrame | None = None, requested: DataFrame | None = None
) -> DataFrame:
    """Profile, audit and decision of every product in ``product_entities``, with rewritten listings where answers are given.

    ``rewrites`` holds (asin, rewritten_title, rewritten_description, changes_made); products without mismatches are
    never rewritten, so theirs are ignored.
    """
    audited = audit(complaint_profiles(entities, requested), products)
    if rewrites is None:
        schema = "asin string, rewritten_title string, rewritten_description string, changes_made array<string>"
        rewrites = entities.sparkSession.createDataFrame([], schema)
    joined = decide(audited).join(rewrites, "asin", "left")
    routed = [F.when(F.col("mismatch_count") > 0, F.col(c)).alias(c)
              for c in ("rewritten_title", "rewritten_description", "changes_made")]
    return joined.select(
        "asin", "review_count", "avg_rating", "negative_pct", "mismatches", "audit_summary", *routed,
        "final_status", "supervisor_notes",
    )
