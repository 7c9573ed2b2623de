"""Time the registered queries and print one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. Every result is written to
Spark's no-op sink, so whole results are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from fluxgauge.plans.catalog import QUERIES
from fluxgauge.session import local_session

HEADLINE = (
    "devices_list", "latest_from_audit", "dedup_accept", "telemetry_append", "rejects", "out_of_order_flag",
    "projection_history", "projection_merge", "event_serialize", "src_json_ingest", "no_loss_reconcile",
    "telemetry_counters", "processing_time_stats", "rolling_failure_rate", "state_transitions", "rate_from_counter",
    "prom_range_asof", "histogram_quantile", "alerts_sustained", "dlq_list", "trace_summary", "span_parent_self_time",
    "service_edges", "log_trace_join", "stream_dedup", "stream_latest",
)


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))

    def noop(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    noop("devices_list")  # starts the JVM's compilers; not timed
    timings = {name: round(seconds(lambda: noop(name)), 3) for name in HEADLINE}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(os.path.basename(sf_dir).removeprefix("sf")),
        "rows_per_second_validate_dedup_latest": round(rows / (timings["telemetry_append"] + timings["devices_list"])),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
