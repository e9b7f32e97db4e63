"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilark import registry  # noqa: E402
from vigilark.session import get_session  # noqa: E402

HEADLINE = [
    "scan_risk_score", "f1_rule_matches", "f8_valid_matches", "f1_document_secrets", "c12_finalized", "f10_emitted", "taint_context", "j2_band_join", "a3_display_score", "a6_merge_duplicates",
    "a7_cross_scanner_dedup", "o1_report_sort", "a10_window_summary", "a12_advisory_rollup", "a13_least_upgrade", "p13_collect", "w5_trailing_count", "w6_near_duplicate", "k3_job_status", "t8_js_taint", "t5_hybrid_dispatch",
    "s9_advisory_lookup", "k8_cache_fetches", "t4_sql_variables", "f1_indexed_matches",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, names = registry.queries(), list(HEADLINE)
    if importlib.util.find_spec("vigilark.llm") is not None and importlib.util.find_spec("vigilark.llm.queries") is not None:
        llm = importlib.import_module("vigilark.llm.queries").queries()
        queries, names = {**queries, **llm}, names + list(llm)
    run = lambda n: queries[n](spark, sf).write.format("noop").mode("overwrite").save()
    run("scan_risk_score")  # the first query also starts the JVM's compiler
    took = {}
    for n in names:
        began = time.time()
        run(n)
        took[n] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "cpus": cpus, "spark": spark.version, "shuffle_partitions": 8}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
