"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tastemap import plans  # noqa: E402
from tastemap.plans.registry import QUERIES  # noqa: E402
from tastemap.session import local_session  # noqa: E402

HEADLINE = [
    "domain_stats", "domain_stats_monthly", "interest_stats", "representative_posts", "chronological_chunks", "time_phases",
    "gate_verdicts", "free_text", "duplicate_tokens", "masked_identifiers", "topic_mentions", "profile_metrics",
    "scored_turns", "condition_means", "paired_bootstrap", "temporal_confusion",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    plans.load_all()
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
