"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftlog.plans import registry  # noqa: E402
from siftlog.session import build_session, ensure_utc  # noqa: E402

HEADLINE = [
    "latest_revision", "activity_buckets", "search_keyset_page", "composite_totals", "receipt_state_refresh", "retention_candidates",
    "reconcile_references", "dataset_rows", "batch_bounds", "counter_rates", "detect_outcome", "parse_kv", "parse_json", "parse_cef", "interpret_status_by_action",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = ensure_utc(build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}))
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"), "events": events}
    for name in ("interpret_status_by_action", "detect_outcome", "parse_kv"):
        if seconds.get(name):
            line[f"{name}_events_per_s"] = round(events / seconds[name], 1)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
