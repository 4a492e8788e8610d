"""Times the headline queries: second, warm run of each, result forced by a noop write.

The total is of these.  `other` has what they leave out: storing the derived
tables that the queries read, streams and further searches, each run once.

Prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "facets_after_dedup", "dedup_sweep", "standardized_postings", "preset_membership", "feed_page", "feed_totals",
    "axis_facets", "metadata_facets", "company_directory", "platform_statistics", "source_statistics", "same_company",
    "posted_dates", "live_reconcile", "batch_rebuild", "source_sync", "liveness_sweep", "empty_board_backoff",
    "payload_greenhouse", "linked_data_postings", "page_texts", "text_index", "text_search", "verification_gate",
    "markdown_feeds", "atom_feeds", "description_shards", "source_lifecycle",
]
OTHER = ["phrase_search", "negative_search", "stored_index_search", "search_with_substrings", "ingest_stream", "lifecycle_stream", "stall_stream"]


def main() -> None:
    from joblattice.plans.bindings import TABLES, bound
    from joblattice.plans.catalog import QUERIES
    from joblattice.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "joblattice-bench")
    times, other = {}, {}
    for name in TABLES:
        start = time.perf_counter()
        bound(spark, sf_dir, name)
        other[f"store_{name}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    for name in OTHER:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        other[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "other": other,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
