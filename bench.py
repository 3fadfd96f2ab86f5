"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from watchloom.plans import catalogue  # noqa: E402
from watchloom.session import JIT_LIMIT  # noqa: E402

HEADLINE = (
    "telemetry_by_hour", "written_feeds", "feed_gates", "sorted_feed_file", "appliance_lines", "cef_lines",
    "field_value_counts", "value_pools", "transitions", "time_inversions", "arrival_serials",
    "virtual_timeline", "follow_ups", "bound_placeholders", "sampled_noise", "inherited_context",
    "top_rows_per_group", "malicious_stage_size", "attack_coverage", "rule_quality", "ingestion_arrays",
    "streamed_hourly_rate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    # compiled code and Python workers belong to the session, not to the first query
    queries["appliance_lines"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries["transitions"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
        # written_feeds and feed_gates play every event twice: once as itself, once as a Linux record
        "events_per_s": {"all_feeds_written": round(2 * events / seconds["written_feeds"], 1),
                         "sorted_feed": round(events / seconds["sorted_feed_file"], 1)},
    }))


if __name__ == "__main__":
    main()
