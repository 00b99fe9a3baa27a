"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of threads. Each
query runs once to warm up and once timed, into the no-op sink, so that rows
are computed in full but not brought to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from quire.registry import queries
from quire.session import build_session

HEADLINE = [
    "search_report", "search_hits", "search_excerpts", "backup_inventory", "retention_deletions",
    "coalesced_snapshots", "content_digests", "character_stats", "typography_rewrite", "assembled_manuscripts",
    "current_documents", "change_kinds", "revision_gaps", "lane_heads", "batch_status", "latest_events",
    "idempotency", "replayed_ledger", "event_append_outcomes", "pull_decisions", "path_ownership",
    "table_fingerprint", "corpus_fingerprint", "folder_paths", "documents_under_folder", "import_issues",
    "name_collisions", "reconciled_versions", "latency_summary", "debounced_bursts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    known, timings = queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            begin = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
