"""Headline queries, timed one after another; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from broadsheet.plans import load_catalog
from broadsheet.session import build_session

HEADLINE = (
    "quality_by_language", "cluster_articles", "segment_pages", "blocks_from_markup", "merge_blocks", "normalize_page_boxes",
    "plan_ingest", "job_detail", "stage_progress", "recent_logs", "raw_text_in_box", "heuristic_relevance", "delivery_preview",
    "extract_fields", "join_pages_markdown", "stable_files",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
                                               "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_catalog()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
