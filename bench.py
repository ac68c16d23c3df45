"""Headline queries, timed one by one; prints one JSON line.

Every query runs once to warm up at the smallest scale, then once for the clock, and its
result goes to Spark's ``noop`` sink so that all of it is computed and none of it collected.
"""
from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["module_overview", "classify_files", "chunk_lines", "directory_rollup", "presence_signals", "scan_defects",
            "http_contracts", "entities", "dependencies", "evidence", "pack_score", "keyword_features", "calibrate_confidence",
            "validate_features", "signal_features", "functional_requirements", "text_scores", "score_document", "repair_grounding"]


def main() -> None:
    from corpuscope.queries import QUERIES
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else SF_DIR
    times = {}
    for name in HEADLINE:
        QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
