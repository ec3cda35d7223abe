"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1). BENCH_CPUS: local threads (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = (
    "repetition_profile", "line_spans", "reference_overlap", "anchor_tokens", "rare_token_blocks", "token_recall", "baseline_pick", "vote_regions", "splice_text",
    "provenance_partition_check", "interval_union", "interval_join", "title_proof", "run_terminal_state", "session_inactivity", "usage_rollup", "case_costs", "corpus_summary",
    "structural_units", "aligned_units",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from vellum.plans.catalogue import QUERIES
    from vellum.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"), **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers and the Python workers
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
