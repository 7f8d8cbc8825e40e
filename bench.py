"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``python bench.py --all`` times every registered query instead.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from paperloom.queries import load
from paperloom.session import build_session

HEADLINE = (
    "e3_section_boost",        # boosted vector top-k
    "d6_hit_dedupe",
    "d3_opening_duplicates",   # embedding duplicates, exact
    "d2_title_trigrams",       # trigram title match
    "b5_running_headers",      # header removal
    "b10_section_merge",       # sections
    "c3_chunks",               # chunking
    "h4_top_concepts",         # concept counts
    "h6_concept_trends",       # concept trends
    "h9_dashboard",
    "e8_keyword_search",
    "l2_window_budget",        # anchored-window budget
    "g6_gap_evidence",
    "plan_model_requests",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = list(queries) if "--all" in sys.argv else HEADLINE
    # Start the JVM's scan path and the Python workers before the clock runs.
    spark.read.parquet(f"{folder}/region.parquet").mapInPandas(lambda it: it, "r_regionkey int, r_name string").count()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        if "--all" in sys.argv:
            print(name, seconds[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
