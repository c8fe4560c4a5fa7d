"""Benchmark the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

One warm-up pass runs every query once (JIT, generated code, file cache),
then ``BENCH_RUNS`` rounds (default 3) run every query once each, interleaved
so that no query is always measured first; the median wall time per query is
reported. Wall time includes building the DataFrame (driver planning) and is
measured through the ``noop`` sink, so nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["a1_order_health", "t1_classify_payload", "t2_enrich_orders", "j1_remediate",
            "c10_decide", "w2_counter_rate", "w5_alert_states", "a8_evidence_counts",
            "a13_scorecard", "r1_live_request_counters"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    from shopguard.plans.catalog import queries
    from shopguard.session import get_session

    spark = get_session(f"local[{cpus}]", cpus, app="shopguard-bench",
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = queries()
    failed: dict[str, str] = {}

    def run(name: str) -> float | None:
        # A failing query is reported (stderr, "failed") and skipped; the others still run.
        if name in failed:
            return None
        t0 = time.perf_counter()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
            print(f"bench: {name} failed: {failed[name]}", file=sys.stderr)
            return None
        return time.perf_counter() - t0

    for name in names:  # warm-up pass
        run(name)
    samples: dict[str, list[float]] = {n: [] for n in names}
    for _ in range(runs):
        for name in names:
            t = run(name)
            if t is not None:
                samples[name].append(t)
    timings = {n: round(statistics.median(v), 3) if v else None for n, v in samples.items()}

    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).count()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    out = {
        "metric": "headline_total_sec",
        "value": round(sum(t for t in timings.values() if t is not None), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "r1_rows_per_sec": round(events / timings["r1_live_request_counters"], 1)
        if timings.get("r1_live_request_counters") else None,
        "spark": spark.version,
        "cores": cpus,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "runs": runs,
        "failed": failed,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
