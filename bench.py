"""Time the headline queries. Settings: BENCH_SF_DIR, BENCH_CPUS. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewmill.plans import registry  # noqa: E402
from reviewmill.plans.driver_views import Tables  # noqa: E402
from reviewmill.session import build_session  # noqa: E402

HEADLINE = [
    "str02_entities", "str01_complaint_score", "str06_style_features", "str08_rule_percents", "agg06_daily_features",
    "agg08_entity_counts", "win02_rolling_sentiment", "snk05_replace_features", "ml04_flagged_days", "ml05_alerts",
    "ml16_column_drift", "agg04_top_products", "agg09_complaint_profiles", "dec05_product_audit", "win03_most_helpful",
    "win05_newest_first", "mcl03_summary_inputs", "src05_latest_reviews", "top03_negative_sample", "ml10_threshold_sweep",
    "ml13_cosine_search", "ml14_ab_test", "ml12_text_vectors", "mcl04_training_pairs", "joi01_reviews_with_products", "agg16_word_frequencies", "stm02_daily_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        f"local[{cpus}]", cpus, spark__ui__enabled="false", spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="reviewmill-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)

    tables = Tables(spark, sf_dir)
    timed("prepare_reviews", lambda: tables.reviews)
    timed("prepare_features", lambda: tables.features)
    timed("prepare_entities", lambda: tables.entities)
    timed("prepare_scores", lambda: tables.scores)
    for name in HEADLINE:
        timed(name, lambda: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    reviews = tables.reviews.count()
    print(json.dumps({
        "metric": "review analytics headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "reviews": reviews,
        "extraction_reviews_per_sec": round(reviews / times["str02_entities"]),
        "features_reviews_per_sec": round(reviews / times["prepare_features"]),
    }))


if __name__ == "__main__":
    main()
