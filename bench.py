"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
Each query is run in full into Spark's `noop` sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINES = [
    "product_library", "quota_library", "category_counts", "sample_orders", "reservoir_documents", "train_eval_split",
    "merged_sets", "context_products", "absent_feature_pairs", "satisfying_ids", "pick_one_tasks", "pick_list_tasks",
    "reject_tasks", "clarify_tasks", "chat_verdicts", "prompts", "nearest_products", "product_contexts",
    "policy_answers", "clean_replies", "resolved_replies", "routed_stream", "evaluated_runs", "metrics_document",
]


def main() -> None:
    from aislekit.session import build_session
    from checks.all import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="aislekit-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    # A first query over the tables, not counted: it carries the start of executors and of compilation.
    start = time.perf_counter()
    QUERIES["category_counts"](spark, sf_dir).collect()
    warm_up = round(time.perf_counter() - start, 3)
    times, built = {}, {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)  # jobs that a query runs while it is built count as well
        built[name] = round(time.perf_counter() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir,
        "build": built, "warm_up": warm_up,
    }))


if __name__ == "__main__":
    main()
