"""Plan properties behind the scale claims (checked on the physical plans)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data absent")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = physical(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_topk_uses_partial_window_group_limit(spark):
    from monthpick.operators.selection import select_opportunities
    from monthpick.plans.context import inputs
    from monthpick.operators.features import feature_matrix

    i = inputs(spark, SF)
    m = feature_matrix(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features)
    plan = physical(select_opportunities(m))
    assert plan.count("WindowGroupLimit") >= 2  # partial (before the shuffle) + final


def test_month_bounds_reach_the_scan(spark):
    from monthpick.plans.pipelines import load_for_targets
    from monthpick.sources.adapters import driver_sources

    d = load_for_targets(driver_sources(spark, SF), "1997-01", "1997-12")
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # untruncated PushedFilters
    try:
        plan = physical(d.sim_daily)
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "GreaterThanOrEqual(l_shipdate,1996-12-01T00:00)" in plan
    assert "LessThan(l_shipdate,1997-12-01T00:00)" in plan


def test_threshold_sweep_is_one_aggregation_without_join(spark):
    from monthpick.operators.metrics import threshold_sweep

    df = spark.createDataFrame([("F", 0.3, 1), ("F", 0.6, 0)], "fold string, proba double, label int")
    plan = physical(threshold_sweep(df))
    assert "Join" not in plan and "Expand" not in plan


def test_matrix_shuffles_each_staged_input_once(spark):
    """Three staged inputs, one shuffle on (EID, PEAKID) for all of them and one for the labels' sums; no join but with calendar tables."""
    import re

    from monthpick.operators.features import feature_matrix
    from monthpick.plans.context import inputs

    i = inputs(spark, SF).stage_all()
    plan = physical(feature_matrix(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features))
    keyed = re.findall(r"Exchange hashpartitioning\(EID#\d+, PEAKID#\d+(?:, \w+#\d+L?)?, \d+\), (\w+)", plan)
    assert sorted(keyed) == ["ENSURE_REQUIREMENTS", "REPARTITION_BY_COL"]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_history_rows_are_not_copied(spark):
    """Rows that meet in the window: a row for each label month of a key and one for each result."""
    from pyspark.sql import functions as F

    from monthpick.operators.features import hist_features, hist_month_map

    months = [202201 + m for m in range(12)]
    hist = spark.createDataFrame([("E", m, 0, 1.0, 1.0, 0.0, False) for m in months], "EID string, MONTH int, PEAKID int, PR double, C double, PROFIT double, IS_PROFITABLE boolean")
    targets = spark.createDataFrame([(m + 1,) for m in months[:-1]], "TARGET int")
    for lookback in (3, 12):
        out = hist_features(hist, hist_month_map(hist, targets, lookback), lookback)
        rows = out._jdf.queryExecution().optimizedPlan()
        assert out.count() == 11 and "Expand" not in rows.toString()
        active = out.select(F.col(f"hist_months_active_{lookback}m").alias("n"), "TARGET").orderBy("TARGET").collect()
        assert [r["n"] for r in active] == [min(k + 1, lookback) for k in range(11)]
