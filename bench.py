"""Times the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores. The small tables are one
row group each, which one core would read; before the clock starts they are written again as a file per core, the
layout that big tables have anyway.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from parlance.plans.catalog import QUERIES  # noqa: E402
from parlance.session import local_session  # noqa: E402

HEADLINE = (
    "overall_summary", "messages_by_hour", "weekday_hour_heatmap", "longest_silences", "median_reply_gap",
    "person_stats", "mention_edges", "search_table", "activity_segments", "segment_contributors",
    "vocabulary", "distinctive_words", "repeated_phrases", "signature_words", "merged_archive", "parsed_exports", "exact_runs",
)
TABLES = ("events", "documents", "conversations", "benchmark", "nation", "region")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    tables = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{tables}/{name}.parquet")
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
