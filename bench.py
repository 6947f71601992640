"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from folioscope.plans import catalog
from folioscope.session import local_session

HEADLINE = [
    "fingerprint", "drift_classify", "drift_counts", "snapshot_diff", "exact_duplicates", "normalise_text", "match_key", "line_explode", "blank_collapse", "section_segments", "heading_index", "definition_tables",
    "range_owner", "overlap_count", "interval_merge", "cluster_positions", "nearest_marker", "grid_place", "ordered_merge", "fidelity_first_diff", "fidelity_full", "link_extract", "link_resolve", "impact_pages",
    "integrity_findings", "read_budget", "catalog_index", "trace_metrics", "corpus_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")), memory=os.environ.get("BENCH_MEMORY", "8g"))
    run = lambda f: f(spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(catalog.QUERIES["fingerprint"])  # the session's own start is no query's time
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(catalog.QUERIES[name])
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
