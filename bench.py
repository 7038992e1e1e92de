"""Time the headline queries: one JSON line, median of BENCH_REPEATS runs after a warm-up, and how much longer each takes
than on the folder of a tenth of the scale, if that lies beside it (one run there, after its own warm-up)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from panelspark.plans import QUERIES
from panelspark.session import local_session

HEADLINE = [
    "q4_parallel_trends", "i3_pre_post_diff", "n4_change_from_base_quarterly", "q5_unit_quarter_series",
    "j5_period_apply_person_month", "e5_observed_in_all", "f6_follow_up", "e7_global_quantiles", "f3_null_safe_ntile",
    "e14_spearman", "m1_within_slope", "m3_poisson_area_effects", "m4_fixed_effect_poisson", "m5_fixed_effect_logit",
    "m7_cluster_se_did",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    smaller = f"{folder.rstrip('/')[: -len(scale)]}{float(scale) / 10:g}" if scale.replace(".", "", 1).isdigit() else ""

    def run(name: str, place: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, place).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times, ratios = {}, {}
    for name in HEADLINE:
        run(name, folder)
        times[name] = round(statistics.median(run(name, folder) for _ in range(repeats)), 3)
        if os.path.isdir(smaller):
            run(name, smaller)
            ratios[name] = round(times[name] / run(name, smaller), 2)
        print(f"{name} {times[name]} {ratios.get(name, '')}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": scale, "ratio_to_tenth": ratios, "cpus": cpus, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
