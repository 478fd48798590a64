"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trackloom.plans.catalog import QUERIES  # noqa: E402
from trackloom.plans import metric_queries, views  # noqa: E402
from trackloom.session import local_session  # noqa: E402

HEADLINE = [
    "build_transitions", "sector_neighbors", "frame_ttc", "mmd_linear", "mmd_exact", "ttc_errors", "slice_metrics", "trajectory_summary",
    "longtail_scores", "resampled_tracks", "smoothed_positions",
]


def timed(run) -> float:
    start = time.time()
    run()
    return round(time.time() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    runs = int(os.environ.get("BENCH_RUNS", "2"))  # the first run warms up
    queries = {
        "land_tracks": timed(lambda: views.tracks(spark, folder).count()),
        "land_windows": timed(lambda: views.windows(spark, folder).count()),
        "land_rollout": timed(lambda: metric_queries.trajectory_rows(spark, folder).count()),
    }
    for name in HEADLINE:
        run = lambda: QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()  # noqa: E731, B023
        queries[name] = min(timed(run) for _ in range(runs))
    total = round(sum(queries.values()), 3)
    print(json.dumps({"metric": "trajectory_analytics_total", "value": total, "unit": "sec", "queries": queries, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
