"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import CHECKS  # noqa: E402
from wardline.session import local_session  # noqa: E402

HEADLINE = [
    "scan_needles_description", "structural_relay", "tfidf_similarity", "scan_surface", "scan_tools",
    "scan_needles_response", "definition_drift", "analyze_with_baseline", "sequence_findings",
    "envelope_violations", "pair_replies", "boundary_cases", "risk_heuristic", "precision_recall_f1",
    "apply_suppressions", "sarif_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: CHECKS[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("scan_needles_description")  # starts the JVM and the Python workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
