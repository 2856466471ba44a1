"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from lanternlog.plans.registry import QUERIES
from lanternlog.session import local_session

HEADLINE = [
    "rule_score_by_service", "rule_score_enriched", "otlp_roundtrip", "parsed_messages", "error_templates",
    "document_signals", "zscore_rows", "erroring_services", "immediate_events", "windowed_events", "hourly_features",
    "request_failures", "dependency_edges", "causal_root", "ticket_windows", "incidents_open", "incident_evidence",
    "similar_resolved", "recent_duplicates", "transitions", "search_logs", "search_fulltext", "overview_24h",
    "incident_facets", "mttr", "tenant_quota", "api_key_resolve", "schema_check",
]


def run(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g", "bench")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)  # warm up
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {
        "parse_rows_per_s": round(events / seconds["otlp_roundtrip"]),
        "rule_score_rows_per_s": round(events / seconds["rule_score_by_service"]),
        "composite_rows_per_s": round(events / seconds["windowed_events"]),
    }
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, warm median",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )


if __name__ == "__main__":
    main()
