"""Benchmark: wall-clock of the headline registered queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query runs to completion through the no-op sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hybridrank.plans import catalog  # noqa: E402
from hybridrank.session import local_session  # noqa: E402

HEADLINE = [
    "postings_tf",
    "term_idf",
    "bm25_topk",
    "qrels",
    "dense_topk",
    "dense_hashed_topk",
    "rank_matrix",
    "expert_scores_norm",
    "fused_topk",
    "metrics_summary",
    "balance_classes",
    "routed_benchmark",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="hybridrank-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
