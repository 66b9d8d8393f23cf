"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the run.
Each query runs once to warm up the JVM and is then timed once, counting all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from chronoseal.plans import load_all
from chronoseal.session import local_session

HEADLINE = (
    "evidence_markers",
    "post_blocks",
    "temporal_features",
    "timeline_blocks",
    "relevance_sequences",
    "evidence_packs",
    "lexical_relevance",
    "pooled_vectors",
    "ordered_match",
    "split_manifest",
    "ternary_manifests",
    "oof_audit",
    "threshold_sweep",
    "leaderboard",
    "fold_robustness",
    "probability_quality",
    "select_exhaustive",
    "select_fixed_set",
    "select_ternary",
    "nested_selection",
    "override_comparison",
    "bootstrap_intervals",
    "error_patterns",
    "oof_logreg",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry = load_all()
    spark = local_session(cpus, "bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        run = registry[name].run
        for timed in (False, True):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
