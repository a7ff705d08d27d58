"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores. Every query runs once
on the smallest tables first, so that the timed run measures work and not class loading.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from contactloom.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "page_emails",
    "document_emails",
    "canonical_links",
    "link_graph",
    "host_emails",
    "crawl_reach",
    "crawl_exact_reach",
    "crawl_emails",
    "scan_batch",
    "cache_hits",
    "cache_upsert",
    "job_state",
    "job_outcome_rows",
    "webhook_payloads",
    "delivery_outcomes",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("contactloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    warm_up = str(Path(sf_dir).parent / "sf0.001")
    for name in names:
        run(spark, name, warm_up if Path(warm_up).exists() else sf_dir)
    times = {name: run(spark, name, sf_dir) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
