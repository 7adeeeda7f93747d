"""Every registered query against its independent SQL, and the shape of its plan."""

import re

import pytest
from compare import compare, connect

from sparkwitness.catalog import core
from plans import flags

FOLDER = "/root/testdata/sf0.001"
QUERIES = core.queries()
SQL = core.oracle_sql()
# Statuses that need more rows than the smallest tables have.
LADDERS = {
    "branch_1_receipts": ("decision", 6),
    "coord_2_hold_clauses": ("endpoint", 3),
    "hist_5_change_classes": ("change_class", 3),
    "lesson_1_promotions": ("status", 6),
    "mem_2_primary_case_edges": ("state", 5),
    "mem_3_edge_semantics": ("reason", 10),
    "obl_1_durable_obligations": ("status", 4),
    "obs_3_frontiers": ("status", 4),
    "plan_1_probe_candidates": ("status", 6),
    "plan_2_probe_plans": ("status", 4),
    "plan_4_observation_probes": ("status", 3),
    "close_2_re_reports": ("re_report", 3),
    "close_3_duplicate_challenges": ("challenge", 3),
    "ci_2_filter_outcomes": ("outcome", 4),
    "front_1_episode_front": ("next", 10),
    "proof_1_surfaces": ("status", 7),
    "prom_2_receipts": ("disposition", 3),
    "prom_4_base_relation": ("relation", 5),
    "proxy_1_revisions": ("status", 9),
    "recon_1_reconciliations": ("status", 11),
    "ref_2_refinements": ("status", 5),
    "rev_2_disposition": ("disposition", 4),
    "rev_3_review_events": ("violation", 7),
    "trial_2_pairs": ("status", 5),
    "trial_3_pair_admission": ("verdict", 4),
    "trial_4_demand_retirement": ("verdict", 8),
    "trial_5_run_violations": ("reason", 5),
    "trial_7_failure_boundaries": ("boundary", 13),
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    _, problem = compare(spark, duck, FOLDER, name, QUERIES[name], SQL.get(name))
    assert problem is None, problem


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("str_")])
def test_plan_has_no_product_and_no_single_partition(spark, name):
    found = flags(QUERIES[name](spark, FOLDER))
    assert "product" not in found and "nested loop" not in found, found
    assert "python" not in found, found
    if name != "beh_2_summary":
        assert "single partition" not in found, found


@pytest.mark.parametrize("name", list(LADDERS))
def test_every_status_of_a_ladder_occurs(spark, name):
    column, statuses = LADDERS[name]
    seen = {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert len(seen) >= statuses, seen


# Scans of the largest table and shuffles that an initial plan may hold, no exchange reused.
LIMITS = {
    "gen_2_missing_companions": ("lineitem", 12, 60), "hist_2_companions": ("lineitem", 5, 30), "hist_3_directional_pairs": ("lineitem", 5, 32),
    "hist_6_class_cohort": ("lineitem", 6, 32), "hist_7_cohort_compare": ("lineitem", 5, 30), "front_1_episode_front": ("orders", 11, 42),
    "pol_1_successor_violations": ("events", 5, 15), "pol_4_effect_violations": ("events", 7, 25), "mem_5_lineage": ("orders", 7, 20),
    "work_3_heads_up": ("orders", 3, 22), "close_4_closure_episodes": ("orders", 2, 6), "snap_1_work_fact_identity": ("orders", 4, 40),
}


@pytest.mark.parametrize("name", list(LIMITS))
def test_plan_reads_and_moves_no_more_than_this(spark, name):
    table, scans, shuffles = LIMITS[name]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(rf"FileScan parquet.*?/{table}\.parquet", plan)) <= scans
    assert plan.count("Exchange hashpartitioning") <= shuffles


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
