"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from acadspark.catalog import load_all
from acadspark.session import build_session

HEADLINE = (
    "link_report", "categorize_url", "validate_links", "secondary_candidates", "dedup_people", "merge_people", "lab_rollup",
    "person_metrics", "lab_people", "relationship_map", "url_candidates_top", "top_candidates", "verify_candidates",
    "find_lab_links", "page_contacts", "scholar_metrics", "extract_emails", "lab_text_fields", "keyword_freq", "throttle_audit",
    "upsert_table", "enrich_pages", "directory_people", "process_links_full", "stream_sessions", "resolve_person", "full_refresh",
)

#: Table whose rows a query goes through, where it is not the people of ``orders``.
READS = {"extract_emails": "documents", "keyword_freq": "documents", "lab_text_fields": "documents", "throttle_audit": "events", "stream_sessions": "events",
         "lab_rollup": "lineitem", "person_metrics": "lineitem", "upsert_table": "orders"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.acadspark.scan.tasks": cpus, "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = load_all()
    queries["people_preview"](spark, sf_dir).collect()  # warm-up of the session
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in {"orders", *READS.values()}}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "rows": rows,
                      "rows_per_second": {n: round(rows[READS.get(n, "orders")] / s) for n, s in seconds.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
