"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from bidloom.plans import registry
from bidloom.session import local

HEADLINE = (
    "price_summary_ce", "price_summary_qty", "outcome_choice", "item_verdicts", "stage_summary", "corrections_applied", "redecide_changed",
    "version_diff", "latest_per_key", "rate_limit_slots", "peak_calls", "page_at_offset", "running_furniture", "line_budget", "quote_on_text",
    "check_math", "cell_placement", "subtree", "usage_rollup", "ext_tumbling",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local(cpus, cpus)
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in HEADLINE:
        begin = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
