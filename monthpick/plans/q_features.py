"""Registered queries: features, history window, dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthpick.functions.months import col_month_to_str
from monthpick.operators.dataset import dataset_stats, labeled_dataset, monthly_build_stats
from monthpick.operators.features import (
    feature_matrix,
    hist_features,
    hist_month_map,
    sim_daily_features,
    sim_monthly_features,
)
from monthpick.plans.context import finish, inputs
from monthpick.plans.oracle_sql import ctes, month_str, rnd, rounded
from monthpick.plans.registry import query
from monthpick.schema import hist_feature_names, matrix_feature_names, sim_feature_names

SM = sim_feature_names("sm", "PSM")
SD = sim_feature_names("sd", "PSD")
HF = hist_feature_names(6)
FEATS = matrix_feature_names(6)


def _with_month(df):
    return df.select(
        col_month_to_str("TARGET").alias("TARGET_MONTH"), *[c for c in df.columns if c != "TARGET"]
    )


@query(
    "sim_monthly_features",
    ctes("sm") + f"SELECT {month_str('TARGET')} AS TARGET_MONTH, EID, PEAKID, {rounded(SM)} FROM sm",
)
def q_sim_monthly_features(spark, sf_dir):
    return finish(_with_month(sim_monthly_features(inputs(spark, sf_dir).sim_monthly)))


@query(
    "sim_daily_features",
    ctes("sd") + f"SELECT {month_str('TARGET')} AS TARGET_MONTH, EID, PEAKID, {rounded(SD)} FROM sd",
)
def q_sim_daily_features(spark, sf_dir):
    return finish(_with_month(sim_daily_features(inputs(spark, sf_dir).sim_daily)))


@query(
    "scenario_std",
    ctes("sm") + f"SELECT {month_str('TARGET')} AS TARGET_MONTH, EID, PEAKID, "
    f"{rounded(['sm_PSM_scenario_std'])} FROM sm",
)
def q_scenario_std(spark, sf_dir):
    sm = sim_monthly_features(inputs(spark, sf_dir).sim_monthly)
    return finish(_with_month(sm.select("TARGET", "EID", "PEAKID", "sm_PSM_scenario_std")))


def _targets(i):
    """Target months: those with a keyed monthly-sim row (no aggregate is needed to list them)."""
    return i.sim_monthly.where("EID IS NOT NULL AND PEAKID IS NOT NULL").select(F.col("MONTH").alias("TARGET")).distinct()


@query(
    "hist_month_map",
    ctes("month_map") + f"SELECT {month_str('TARGET')} AS TARGET_MONTH, MONTH FROM month_map",
)
def q_hist_month_map(spark, sf_dir):
    i = inputs(spark, sf_dir)
    targets = _targets(i)
    return _with_month(hist_month_map(i.hist, targets))


@query(
    "hist_features",
    ctes("histf") + f"SELECT {month_str('TARGET')} AS TARGET_MONTH, EID, PEAKID, {rounded(HF)} FROM histf",
)
def q_hist_features(spark, sf_dir):
    i = inputs(spark, sf_dir)
    hist = i.hist
    targets = _targets(i)
    return finish(_with_month(hist_features(hist, hist_month_map(hist, targets))))


@query(
    "feature_matrix",
    ctes("matrix") + f"SELECT EID, PEAKID, {rounded(FEATS)}, TARGET_MONTH FROM matrix",
)
def q_feature_matrix(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    return finish(feature_matrix(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features))


LABELED_SQL = (
    ctes("labeled")
    + f"SELECT EID, PEAKID, {rounded(FEATS)}, TARGET_MONTH, IS_PROFITABLE_L AS IS_PROFITABLE, "
    f"{rnd('PROFIT_L', 4, 'PROFIT')} FROM labeled"
)


@query("labeled_dataset", LABELED_SQL)
def q_labeled_dataset(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    return finish(labeled_dataset(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features))


@query(
    "dataset_stats",
    ctes("labeled")
    + "SELECT count(*) AS n_rows, "
    f"{rnd('avg(CAST(IS_PROFITABLE_L AS DOUBLE)) * 100', 6, 'positive_pct')}, "
    "count(DISTINCT TARGET_MONTH) AS n_months FROM labeled",
)
def q_dataset_stats(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    return finish(dataset_stats(labeled_dataset(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features)))


@query(
    "monthly_build_stats",
    ctes("labeled")
    + "SELECT TARGET_MONTH, count(*) AS n_rows, CAST(sum(IS_PROFITABLE_L) AS BIGINT) AS n_positive, "
    f"{rnd('CAST(sum(IS_PROFITABLE_L) AS BIGINT) / count(*) * 100', 6, 'pct_positive')} "
    "FROM labeled GROUP BY 1",
)
def q_monthly_build_stats(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    return finish(monthly_build_stats(labeled_dataset(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features)))

