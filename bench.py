"""Headline benchmark: runs the main queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is fully executed into Spark's no-op sink (no driver collection).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "F5_label_report",       # flagship: per-run, per-label report
    "F9_run_results",        # run table: accuracy, F1s, MCC per label
    "F12_ensemble_report",   # vote over runs + report
    "F14_history",           # loss / accuracy by epoch and split
    "G1_prob_histograms",
    "E8_compare_runs",
    "B3_dedup_union",        # exact de-duplication of whole sequences
    "B4_similar_pairs",      # homology check against the reference set (whole sequences)
    "B9_split",
    "B10_kfold",
    "C3_build_vocab",
    "C2_encode",
    "D4_gaussian_smooth",
    "D6_attention_pool",
    "G5_knn",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from seqlabel.plans.catalog import queries
    from seqlabel.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="seqlabel-bench")
    qs = queries()
    # warm-up: JVM, parquet readers, Python workers
    qs["F1_bce_loss"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
