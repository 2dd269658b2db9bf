"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import time

from premisa.catalogue import QUERIES
from premisa.session import local_session

HEADLINE = [
    "x13_error_scores",
    "x14_final_table",
    "j15_variant_pivot",
    "a25_box_summary",
    "x19_before_after",
    "e9_build_results",
    "d2_center",
    "m1_mass_mean",
    "e1_score",
    "e7_calibrated",
    "x20_direction_similarity",
    "m3_logistic",
    "m7_reflection",
    "p5_shuffle_premise",
    "p6_letter_noise",
    "p28_substring_positions",
    "d7_load_pairs",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "premisa-bench")
    run(spark, HEADLINE[0], sf)  # untimed: starts the Python workers and warms the JVM
    times = {name: run(spark, name, sf) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
