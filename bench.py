"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import time

from retentia import catalog, session

HEADLINE = [
    "active_customers_any", "contract_target_summary", "work_features", "monthly_property", "explain_wide",
    "recontact_rows", "recontact_calendar", "voc_activity_upsert", "category_slots", "clean_text_a",
    "tfidf_best_term", "longest_match", "cluster_profile", "usage_rate_top3", "nearest_in_cluster",
    "cluster_similarity", "recommendation_payload", "confidence_drift", "monthly_snapshot_json",
    "stratified_split", "stream_recontact",
]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = session.build("bench", f"local[{cores}]", cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    run(queries["qa_value_distribution"](spark, sf_dir))  # starts the executors
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    messages = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    scored = seconds["active_customers_any"] + seconds["explain_wide"] + seconds["recommendation_payload"]
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "customers_per_second": round(customers / scored, 1),
                "messages_per_second": round(messages / seconds["recontact_rows"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
