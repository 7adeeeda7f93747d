"""Headline queries, timed on the folder and cores the driver names; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkwitness.catalog import core  # noqa: E402
from sparkwitness.plans.session import build_session  # noqa: E402

# One or two of every family, the heavy ones first.
HEADLINE = [
    "hist_1_anchor_cohort", "hist_2_companions", "hist_6_class_cohort", "hist_8_scope_history", "gen_2_missing_companions",
    "src_2_changed_ranges", "conv_4_precedent_findings", "ci_2_unmatched_filters", "work_2_inventory_overlap", "work_3_heads_up",
    "work_4_has_overlap", "coord_2_hold_edges", "branch_1_admission", "app_2_applicability", "just_2_claim_status",
    "obl_1_durable_obligations", "plan_2_probe_plans", "obs_3_frontiers", "ref_2_refinements", "mem_1_artifact_edges",
    "mem_5_lineage", "rev_2_disposition", "close_4_closure_episodes", "lesson_1_promotions", "front_1_episode_front",
    "dec_1_decisions_for", "prom_2_receipts", "prom_3_change_set_fingerprint", "beh_2_summary", "trial_3_pair_admission",
    "snap_1_work_fact_identity", "pkt_1_pack_evidence", "scan_1_references", "pol_1_successor_violations", "str_2_overlap_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            # Small files are split among the cores.
            "spark.sql.files.maxPartitionBytes": "2m", "spark.sql.files.openCostInBytes": "256k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    built = core.queries()
    # Start-up is not a query: first action, first parquet footer.
    spark.read.parquet(f"{folder}/region.parquet").selectExpr("count(*)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        built[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
