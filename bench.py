"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables and BENCH_CPUS
(default 8) the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import all_queries  # noqa: E402
from corpuscope.plans.lineage import ensure_shared_dir  # noqa: E402

HEADLINES = [
    "term_analysis",
    "time_analysis",
    "terms_by_year_shares",
    "growth_indicators",
    "impact_analysis",
    "core_authors",
    "bradford_zones",
    "bradford_law",
    "descriptive_statistics",
    "keywords_coverage",
    "co_occurrence",
    "auto_correlation",
    "tfidf",
    "strategic_map",
    "drop_duplicate_records",
    "collocations",
    "to_american",
    "apply_thesaurus",
    "thematic_analysis",
    "path_counts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_dir(spark)
    queries = all_queries()
    times = {}
    for name in HEADLINES:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
