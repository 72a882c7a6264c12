"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The first query runs once untimed, to start the JVM and the Python workers; then every query is timed once.
Results go to a no-op sink, so every row and column is computed but nothing is pulled to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "classify_flows", "classify_flows_scaled", "classify_flows_legacy", "knn_flows", "knn_clustered", "knn_exact",
    "similar_flows", "flow_calibration", "history_search", "history_search_within_type", "fit_preprocessing",
    "featurize", "flow_features", "clean_coerce", "label_encode", "scaler_fit", "anova_f", "split_counts",
    "sample_per_class", "validate_analysis", "prompt_analysis", "analyze_threats", "question_join", "running_number",
    "retention", "stream_classify", "stream_counters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    import catalog
    from flowwarden.session import build_session, release_materialized

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    chosen = sys.argv[1:] or HEADLINE

    def run(name: str) -> None:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        release_materialized(spark)

    run(chosen[0])
    seconds, rates = {}, {}
    for name in chosen:
        start = time.time()
        run(name)
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    flows = catalog.standins.halves(spark, sf_dir).where("split = 'test'").count()
    for name in ("classify_flows", "classify_flows_scaled", "knn_flows", "stream_classify"):
        if name in seconds:
            rates[f"{name}_flows_per_sec"] = round(flows / seconds[name], 1)
    if "history_search" in seconds:
        n = catalog.standins.history(spark, sf_dir).count()
        rates["history_search_queries_per_sec"] = round(n / seconds["history_search"], 1)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "rates": rates, "held_out_flows": flows, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
