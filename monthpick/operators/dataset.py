"""Labeled training dataset: feature matrix + the realized label of the target.

One plan for all months (no yearly temp files): the matrix is left-joined with
the label table on (TARGET, EID, PEAKID); unlabeled rows get label 0 and profit
0 as in the reference (``drop_unlabeled=True`` instead drops target months
that have no label rows at all).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.functions.columns import zero_filled
from monthpick.functions.months import col_month_from_str
from monthpick.operators.features import feature_matrix
from monthpick.schema import DEFAULT_LOOKBACK


def attach_labels(matrix: DataFrame, hist_profit: DataFrame, drop_unlabeled: bool = False) -> DataFrame:
    m = matrix
    drop_target = "TARGET" not in m.columns
    if drop_target:
        m = m.withColumn("TARGET", col_month_from_str("TARGET_MONTH"))
    truth = hist_profit.select(
        F.col("MONTH").alias("TARGET"), "EID", "PEAKID", "IS_PROFITABLE", "PROFIT"
    )
    if drop_unlabeled:
        labeled_months = truth.select("TARGET").distinct()
        m = m.join(F.broadcast(labeled_months), "TARGET", "left_semi")  # <= #months rows
    out = m.join(truth, ["TARGET", "EID", "PEAKID"], "left")
    return out.select(*matrix.columns, *_labels("IS_PROFITABLE", "PROFIT"))


def _labels(profitable: str, profit: str) -> list:
    """Label and profit of a row; without truth both are 0."""
    return [F.coalesce(F.col(profitable).cast("int"), F.lit(0)).alias("IS_PROFITABLE"), F.coalesce(F.col(profit), F.lit(0.0)).alias("PROFIT")]


def labeled_dataset(
    sim_monthly: DataFrame,
    sim_daily: DataFrame,
    hist_profit: DataFrame,
    lookback: int = DEFAULT_LOOKBACK,
    drop_unlabeled: bool = False,
    sm_features: DataFrame | None = None,
    sd_features: DataFrame | None = None,
    truth: DataFrame | None = None,
) -> DataFrame:
    """``truth``: label rows to attach, where they are others than the history's.

    The rows are those of ``attach_labels``; the truth comes with the matrix's own shuffle, so that no row goes through a second one."""
    known = hist_profit if truth is None else truth
    m = feature_matrix(
        sim_monthly,
        sim_daily,
        hist_profit,
        lookback,
        keep_target_int=True,
        sm_features=sm_features,
        sd_features=sd_features,
        truth=known,
    )
    if drop_unlabeled:
        months = known.select(F.col("MONTH").alias("TARGET")).distinct()
        m = m.join(F.broadcast(months), "TARGET", "left_semi")  # <= #months rows
    names = [c for c in m.columns if c not in ("TARGET", "truth")]
    return m.select(*names, *_labels("truth.IS_PROFITABLE", "truth.PROFIT"))


def dataset_stats(ds: DataFrame) -> DataFrame:
    """Rows, positive rate in percent, distinct target months."""
    return ds.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.avg(F.col("IS_PROFITABLE").cast("double")) * 100).alias("positive_pct"),
        F.countDistinct("TARGET_MONTH").alias("n_months"),
    )


def monthly_build_stats(ds: DataFrame) -> DataFrame:
    """Per target month: rows, positives, percent positive."""
    return (
        ds.groupBy("TARGET_MONTH")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col("IS_PROFITABLE").cast("long")).alias("n_positive"),
        )
        .withColumn("pct_positive", F.col("n_positive") / F.col("n_rows") * 100)
    )


def fill_missing_features(df: DataFrame, feat_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Project onto a model's feature list; absent features become 0.0 and
    present ones have nulls and NaN filled with 0 (scoring-time alignment)."""
    present = set(df.columns)
    cols = [F.col(c) for c in (keep or [])]
    for c in feat_cols:
        if c in present:
            cols.append(zero_filled(c).alias(c))
        else:
            cols.append(F.lit(0.0).alias(c))
    return df.select(*cols)
