"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``; every query is executed in full through the ``noop``
sink (no collect), once to warm up and then ``$BENCH_REPEATS`` times (default
3); the median is reported.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textlab.plans.queries import QUERIES  # noqa: E402
from textlab.session import build_session  # noqa: E402

HEADLINE = [
    "reply_pairs", "clean_text", "policy_decision", "text_profile", "top_bigrams",
    "length_stratified_sample", "dedupe_keep_first", "merge_topup", "label_audit",
    "rubric_scores", "eval_metrics", "kappa", "rank_agreement", "response_parse",
    "tfidf_weights", "retrieve_top3_prompt", "retrieve_all_pairs", "weak_labels",
    "scoring_job", "stream_scoring",
]


def run(spark, name, sf_dir):
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="textlab-bench", shuffle_partitions=cpus,
                          conf={"spark.driver.memory": "16g"})
    results = {}
    for name in names:
        run(spark, name, sf_dir)  # warm-up
        times = [run(spark, name, sf_dir) for _ in range(repeats)]
        results[name] = round(statistics.median(times), 3)
        print(f"# {name}: {results[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "sum_of_median_query_sec", "value": round(sum(results.values()), 3),
           "unit": "sec", "queries": results, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "repeats": repeats, "spark": spark.version}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
