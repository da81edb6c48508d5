"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2, the
best counts; a query that takes over SLOW seconds runs once), BENCH_QUERIES (comma-separated
names, default the headline list).
"""

from __future__ import annotations

import json
import os
import time

from tidekeep.plans.catalog import CATALOG, Tables
from tidekeep.session import build_session

SLOW = 8.0
HEADLINE = [
    "cmp_1_review_queue", "cmp_2_run_case", "cmp_3_outreach_grid", "srt_1_ranked_queue",
    "clf_8_listen", "txt_4_detect_language", "ent_5_extract_entities", "clf_1_keyword_issue",
    "rsk_12_assess_risk", "act_6_decide_and_act", "drf_3_serve_decision", "joi_2_queue_status",
    "agg_4_driver_counts", "agg_12_region_audit", "agg_14_overview", "agg_17_accuracy",
    "agg_20_roc_auc", "win_2_latest_verdict", "rev_1_review_transition", "tml_1_case_timeline",
    "tml_2_extended_timeline", "spl_1_message_split", "clf_4_token_ids", "clf_5_vocabulary",
    "ml_3_logistic_scores", "ml_10_scored_book", "str_1_scored_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session("tidekeep-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a fresh session pays for class loading; this run is not counted.
    CATALOG[names[0]](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            CATALOG[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
            if taken > SLOW:
                break
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
