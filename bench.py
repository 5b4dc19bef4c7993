"""Benchmark the headline audit queries.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is forced with a full collect-free action (``count`` over the
result after a ``noop`` write would skip work Spark can prune, so we use the
``noop`` sink, which executes the whole plan).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "l1_near_duplicate_eval",   # K1 -> all pairs -> truth join -> metrics (flagship)
    "j1a_near_duplicates",
    "j1c_label_ratio",
    "l1_label_error_eval",
    "c7_knn",
    "j6_ecod",
    "j9_hbos",
    "j4_phash_pairs",
    "e1_stopping_rule",
    "c6_group_pairs",
    "d5_majority_vote",
    "l8_mann_whitney",
    "l9_wilcoxon",
    "l10_paired_permutation",
    "l6_stratified_split",
    "l13a_knn_classifier",
    "l2_mixed_eval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("BENCH_CPUS", cpus)
    from tidemark.plans.registry import queries
    from tidemark.session import get_spark

    spark = get_spark(master=f"local[{cpus}]")
    qs = queries()
    # warm the JVM and start the Python workers once (not timed): a scan and a
    # trivial Arrow round trip, neither of which is a benchmarked query
    qs["a2_l2_normalize"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(64).repartition(int(cpus)).mapInPandas(lambda it: it, "id long").write.format(
        "noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        t0 = time.time()
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_audit_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
