"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced with a ``noop`` write (full computation, nothing sent to
the driver); after one warm-up query, each query's time is the best of two
runs. ``queries`` holds the headline queries, which run from the raw tables
every time; ``stored`` holds the same results from the prepared table and the
table of counts, and what writing these two costs once (one run each). Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crashlens.plans.catalog import queries, stages_for  # noqa: E402
from crashlens.session import get_spark  # noqa: E402

HEADLINE = [
    "harmonised", "error_rows", "clean_rows_multiset", "unmapped_values", "night_classified",
    "g1_chi2", "g2_chi2", "g2_daypart_severity", "g3_chi2", "g4_winners", "g5_chi2", "g5_night_by_month", "g5_night_by_hour",
    "g7_correlation", "g8_confusion", "g9_misclass_by_month", "g10_monthly_table",
]

STORED = ["prepared_error_rows", "prepared_clean_rows", "prepared_with_hour", "prepared_night_classified", "cube_g1_chi2", "cube_g2_chi2",
          "cube_g3_chi2", "cube_g4_winners", "cube_g5_chi2", "cube_g5_night_by_month", "cube_g7_correlation", "cube_g8_confusion",
          "cube_g9_misclass_by_month", "cube_g10_monthly_table"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", app="crashlens-bench", shuffle_partitions=int(cpus),
                      extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()

    def run(name: str) -> float:
        t = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    run("harmonised")  # JVM / codegen warm-up
    # best of two runs per query: the VM's run-to-run noise is +-1-2 s at this size
    times = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    once = {}
    for name, write in (("write prepared table", lambda s: s.prepared), ("write table of counts", lambda s: s.counts)):
        t = time.perf_counter()
        write(stages_for(spark, sf_dir, prepared=name.endswith("prepared table")))
        once[name] = round(time.perf_counter() - t, 3)
    stored = once | {name: round(min(run(name), run(name)), 3) for name in STORED}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "stored": stored, "sf": sf, "cpus": int(cpus), "stat": "min of 2 runs per query"}))


if __name__ == "__main__":
    main()
