"""Hot keys: one product holds a third of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import aggregates, drift, joins, listing, product_features, ranking
from reviewmill.session import settle

ROWS = 60_000


@pytest.fixture(scope="module")
def reviews(spark):
    ids = spark.range(ROWS, numPartitions=8)
    return settle(
        ids.select(
            "id",
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 997).cast("string"))).alias("asin"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 997).cast("string"))).alias("parent_asin"),
            (F.col("id") % 5 + 1).cast("double").alias("rating"),
            F.lit("Broken").alias("title"),
            F.lit("battery died, screen cracked, waste of money").alias("text"),
            (F.col("id") % 100).cast("int").alias("helpful_votes"),
            F.timestamp_seconds(1_700_000_000 + (F.col("id") % 50) * 86_400).alias("timestamp"),
        ),
        "hot-reviews",
    )


@pytest.fixture(scope="module")
def products(spark):
    keys = spark.range(997).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("parent_asin"))
    keys = keys.union(spark.sql("SELECT 'hot'"))
    return keys.select("parent_asin", F.lit("Battery").alias("title"), *(F.lit("x").alias(c) for c in ("description", "features", "price")))


def shuffled_rows(df):
    """Rows written by every shuffle of the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    rows, stack = [], [plan]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
            continue
        if name == "Exchange":
            rows.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return rows


def test_features_shuffle_reduced_rows(spark, reviews):
    features = product_features.product_features(reviews)
    keys = reviews.select("asin", F.to_date("timestamp")).distinct().count()
    written = shuffled_rows(features)
    # At most one row per map task, product, day and entity (1 review row, 2 components, 3 issues), then one per key.
    assert len(written) == 2 and max(written) <= keys * 6 * 8
    total = features.agg(F.sum(F.col("issues")["died"])).first()[0]
    assert total == ROWS


def test_profiles_of_a_hot_product(spark, reviews, products):
    row = listing.product_audit(listing.product_entities(reviews), products).filter("asin = 'hot'").first()
    assert row["review_count"] == ROWS // 3 and row["final_status"] == "needs_review"


def test_top_reviews_of_a_hot_product(spark, reviews):
    top = ranking.most_helpful(reviews, 5)
    assert max(shuffled_rows(top)) <= 998 * 5 * 8
    hot = [(r["helpful_votes"], r["id"]) for r in top.filter("asin = 'hot'").collect()]
    want = sorted(((i % 100, i) for i in range(0, ROWS, 3)), key=lambda r: (-r[0], r[1]))[:5]
    assert sorted(hot) == sorted(want)


def test_leaderboard_joins_reduced_rows(spark, reviews, products):
    top = aggregates.top_products(reviews, products, 1).first()
    assert (top["asin"], top["review_count"], top["avg_rating"]) == ("hot", ROWS // 3, 3.0)


def test_positions_in_a_hot_product_use_many_tasks(spark, reviews):
    numbered = ranking.newest_first(reviews)
    hot = numbered.filter("asin = 'hot'").agg(F.count("*").alias("n"), F.max("position").alias("m"), F.countDistinct("position").alias("d")).first()
    assert hot["n"] == hot["m"] == hot["d"] == ROWS // 3


def test_no_side_is_marked_for_broadcast(reviews, products):
    for joined in (joins.with_products(reviews, products, "title"), joins.not_done(reviews, reviews.limit(5), "id")):
        assert "broadcast" not in joined._jdf.queryExecution().logical().toString()


def test_many_top_reviews_of_a_hot_product_use_many_tasks(spark, reviews):
    top = ranking.most_helpful(reviews.select("asin", "id", "helpful_votes"), 5_000)
    hot = [(r["helpful_votes"], r["id"]) for r in top.filter("asin = 'hot'").collect()]
    want = sorted(((i % 100, i) for i in range(0, ROWS, 3)), key=lambda r: (-r[0], r[1]))[:5_000]
    assert sorted(hot) == sorted(want)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(asin" in plan and "_slice" in plan


def test_an_outlier_leaves_drift_cells_even(spark):
    rows = spark.range(6_000).select(
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 10).cast("int")).alias("date"),
        F.when(F.col("id") == 0, 1e9).otherwise(F.col("id").cast("double")).alias("x"),
    )
    windowed = drift.with_window(rows, drift.split_date(rows))
    found = drift.column_drift(windowed, ["x"]).first()
    values = [(1e9 if i == 0 else float(i), i % 10 < 7) for i in range(6_000)]
    early, late = sorted(v for v, e in values if e), sorted(v for v, e in values if not e)
    points = sorted({v for v, _ in values})
    share = lambda side, v: np.searchsorted(side, v, "right") / len(side)
    distance = sum(abs(share(early, a) - share(late, a)) * (b - a) for a, b in zip(points, points[1:]))
    assert found["drift_score"] == pytest.approx(distance / np.std(early), rel=1e-9)


def test_a_hot_join_key_is_split(spark, reviews, products):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = joins.with_products(reviews.repartition(8), products, "title")
        rows = joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert len(rows) == ROWS and all(r["product_title"] == "Battery" for r in rows)
