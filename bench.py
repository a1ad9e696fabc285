"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from ruleweave.plans.queries import QUERIES
from ruleweave.session import local_session

HEADLINE = (
    "locations_with_counts", "programme_listing", "verified_catalog", "university_search", "public_rules_snapshot",
    "merge_guarded", "merge_coalesce", "observation_log", "version_diff", "text_normalise", "content_hash_store",
    "html_blocks", "link_extract", "signal_score", "bounded_walk", "carry_forward", "table_islands", "context_window",
    "header_argmax", "relevant_tables", "candidate_extract", "grid_rules", "programme_first_rules", "catalogue_rows",
    "title_match_join", "catalog_match", "unique_resolve", "create_missing_dim", "publish_run", "contract_violations",
    "duplicate_keys", "run_action", "due_targets", "reminder_schedule", "latest_per_key",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "ruleweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.ruleweave.readPartitions", cores)  # each table is one file with one row group
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
