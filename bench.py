"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Queries are planned on the source tables; with BENCH_SHARE set, the mapped
transaction table is written once before them. Each query is executed to completion with the ``noop`` sink (the whole plan
runs, nothing is shipped to Python). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["cohort_cells", "customer_profile", "segments", "pivot_retention",
            "knn_filled_retention", "model_scores_retention"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from vintage.plans.catalog import REGISTRY
    from vintage.session import local_session

    from vintage.session import ensure_checkpoint_dir
    from vintage.sources import share_transactions

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="vintage-bench")
    times = {}
    if "BENCH_SHARE" in os.environ:  # sharing the mapped table is timed on a line of its own
        t0 = time.perf_counter()
        share_transactions(spark, sf_dir, f"{ensure_checkpoint_dir(spark)}/transactions")
        times["share_transactions"] = round(time.perf_counter() - t0, 3)
    for name in names:
        fn, _ = REGISTRY[name]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
