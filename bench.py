"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``; every result is fully executed through the ``noop``
sink (no collect to the driver). One warm-up pass, then the median of
``$BENCH_REPEAT`` (default 3) timed runs per query. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pizarra.plans.queries import REGISTRY  # noqa: E402
from pizarra.session import build_session, clear_stage  # noqa: E402

HEADLINE = [
    "department_ranking",
    "national_indicators",
    "share_all",
    "gap_all",
    "outcome_cube",
    "vs_national",
    "insights_national",
    "insights_department",
    "context_document",
    "answer_batch",
    "municipality_counts",
    "school_counts",
    "code_profile",
    "control_check",
    "municipality_summary",
    "sample_exact",
    "decode_all",
    "scan_departments",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    REGISTRY[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    for name in names:  # warm-up: JIT, file listing
        run(spark, name, sf_dir)
    times = {}
    for name in names:
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_median",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    clear_stage(spark)
    spark.stop()


if __name__ == "__main__":
    main()
