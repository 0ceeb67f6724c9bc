"""Time the headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and three times for the record; the median counts. Results are written to
Spark's no-op sink, so every row and column is computed and nothing goes through the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barograph.plans.catalogue import QUERIES  # noqa: E402
from barograph.session import local_session  # noqa: E402

HEADLINE = [
    "hourly_rollup",
    "messages_by_source",
    "parsed_readings",
    "reject_report",
    "hour_headline",
    "hour_delta_series",
    "source_share",
    "heatmap_weekday_hour",
    "column_profile",
    "live_projection",
    "last_30_points",
    "last_30_per_source",
    "latest_reading",
    "source_freshness",
    "topic_profile",
    "cadence_gaps",
    "mart_upsert",
    "stream_hourly",
    "stream_last_30",
    "nmea_quality",
    "nmea_track",
    "nmea_satellites",
    "calibrated_readings",
]


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=max(1, int(cpus)) if cpus.isdigit() else 8)
    times = {}
    for name in HEADLINE:
        seconds(spark, sf_dir, name)
        times[name] = round(statistics.median(seconds(spark, sf_dir, name) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
