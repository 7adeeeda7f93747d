"""Tests of the findings in FINDINGS_r03.md."""

import pytest
from sparkwitness.catalog import core

QUERIES = core.queries()
FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hist_6_class_cohort", "gen_2_missing_companions"])
def test_large_tables_meet_the_written_cohort_before_they_are_shuffled(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("lineitem.parquet") <= 2 and plan.count("Exchange hashpartitioning") <= 4
    semi = plan.index("LeftSemi")  # plans print parents first: the paths are cut down below their last exchange
    assert "Exchange hashpartitioning" in plan[:semi]


def test_probes_meet_admission_in_the_order_of_their_obligation(spark):
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, "plan_1_probe_candidates")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins and not any("_key" in line for line in joins)  # a second key would sort all probes once more
