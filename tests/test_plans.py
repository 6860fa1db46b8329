"""Shapes of physical plans that matter at scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voltlake import plans  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_partition_filter_reaches_the_scan(spark):
    assert "PartitionFilters: [isnotnull(ds" in plan(spark, "etl_partition_prune")


def test_key_lookup_is_pushed_down(spark):
    assert "EqualTo(c_custkey,42)" in plan(spark, "src_kv_get")


@pytest.mark.parametrize("name", ["win_last_n_messages", "win_recent_errors", "ml_registry_pick", "kb_relevance"])
def test_top_rows_are_limited_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert p.index("Exchange hashpartitioning") < p.rindex("WindowGroupLimit")


def test_only_needed_columns_are_read(spark):
    p = plan(spark, "gov_k_anonymity")
    assert "ReadSchema: struct<c_nationkey:int,c_mktsegment:string>" in p


def test_suite_runs_its_row_checks_in_one_scan(spark):
    assert plan(spark, "dq_between").count("FileScan") == 1


@pytest.mark.parametrize("name", ["join_scenarios_cross", "price_optimise", "risk_stress", "etl_silver_to_gold", "join_point_in_time", "win_scd2", "cost_gate", "ano_usage"])
def test_no_nested_loop_join(spark, name):
    p = plan(spark, name)
    assert "NestedLoop" not in p and "Cartesian" not in p


@pytest.mark.parametrize("name", sorted(n for n in plans.QUERIES if n.startswith(("agg_", "etl_d", "dq_", "pii_", "cost_", "ops_"))))
def test_no_python_in_the_hot_path(spark, name):
    p = plan(spark, name)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
