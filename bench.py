"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
Each query runs once to warm up and is then timed; its rows are written to Spark's null sink,
so nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from driftloom.plans import catalog  # noqa: E402
from driftloom.session import shuffle_partitions  # noqa: E402

HEADLINE = (
    "dom_skeleton",
    "dom_fingerprint",
    "drift_vs_previous",
    "drift_vs_first",
    "drift_report",
    "drift_diff",
    "selector_extract",
    "site_extract",
    "selector_induction",
    "content_section",
    "record_quality",
    "response_ingest",
    "registry_lookup",
    "registry_upsert",
    "extraction_queue",
    "canary_fold",
    "visit_replay",
    "summary_stats",
    "recent_extractions",
    "null_rate_trend",
    "audit_windows",
)

# Pages each query reads, for pages per second: crawled pages, or visits to derived shop pages.
CRAWLED = ("dom_skeleton", "drift_vs_previous", "drift_vs_first", "drift_diff", "site_extract", "content_section")
SHOP = ("dom_fingerprint", "drift_report", "selector_extract", "selector_induction", "visit_replay")
# Four fifths of the products have stored selectors; the other pages are not parsed.
PARSED = {"selector_extract": 0.8}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from pyspark.sql import SparkSession

    size = sum(f.stat().st_size for f in Path(folder).glob("*.parquet"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("driftloom-bench")
        .config("spark.sql.shuffle.partitions", shuffle_partitions(size, cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str, where: str) -> float:
        started = time.perf_counter()
        queries[name](spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    crawled = spark.read.parquet(f"{folder}/pages.parquet").count()
    shop = spark.read.parquet(f"{folder}/part.parquet").count() * catalog.DerivedTables.VISITS
    seconds, rates = {}, {}
    for name in names:
        run(name, folder)
        seconds[name] = round(run(name, folder), 3)
        pages = crawled if name in CRAWLED else shop * PARSED.get(name, 1) if name in SHOP else 0
        if pages:
            rates[name] = round(pages / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
                "pages_per_second": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
