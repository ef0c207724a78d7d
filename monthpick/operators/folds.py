"""Walk-forward folds over target months (expanding training window).

Fold i validates on month ``months[i]`` (i >= min_train_months) and trains on
every dataset row with TARGET_MONTH < that month.  Fold statistics are running
sums over a per-month table (one row per calendar month), never a per-fold copy
of the training rows: O(rows) work however many folds there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthpick.operators.spine import calendar_spine
from monthpick.schema import MIN_TRAIN_MONTHS, MIN_TRAIN_POSITIVES


def month_calendar(ds: DataFrame, month_col: str = "TARGET_MONTH") -> DataFrame:
    """Calendar months between the dataset's first and last target month."""
    ts = F.to_timestamp(F.concat(F.col(month_col), F.lit("-01")), "yyyy-MM-dd")
    return calendar_spine(ds.select(ts.alias("DATETIME")))


def fold_map(ds: DataFrame, min_train_months: int = MIN_TRAIN_MONTHS) -> DataFrame:
    """fold_id, VAL_MONTH, TRAIN_FIRST, TRAIN_LAST, n_train_months."""
    cal = month_calendar(ds)
    w = Window.orderBy("TARGET")  # one row per calendar month
    cal = cal.select(
        "TARGET_MONTH",
        (F.row_number().over(w) - 1).alias("i"),
        F.first("TARGET_MONTH").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("TRAIN_FIRST"),
        F.lag("TARGET_MONTH").over(w).alias("TRAIN_LAST"),
    )
    return cal.where(F.col("i") >= min_train_months).select(
        (F.col("i") - min_train_months + 1).alias("fold_id"),
        F.col("TARGET_MONTH").alias("VAL_MONTH"),
        "TRAIN_FIRST",
        "TRAIN_LAST",
        F.col("i").alias("n_train_months"),
    )


def month_stats(ds: DataFrame, label: str = "IS_PROFITABLE") -> DataFrame:
    return ds.groupBy("TARGET_MONTH").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.countDistinct(label).alias("classes"),
    )


def fold_eligibility(
    ds: DataFrame,
    min_train_months: int = MIN_TRAIN_MONTHS,
    min_positives: int = MIN_TRAIN_POSITIVES,
    label: str = "IS_PROFITABLE",
) -> DataFrame:
    """Per fold: training rows/positives (all months before), validation rows and
    classes, and whether the fold is run (>= min positives, two classes)."""
    folds = fold_map(ds, min_train_months)
    stats = month_stats(ds, label)
    cal = month_calendar(ds).select("TARGET_MONTH").join(stats, "TARGET_MONTH", "left")
    cal = cal.fillna(0, ["rows", "pos", "classes"])
    w = Window.orderBy("TARGET_MONTH").rowsBetween(Window.unboundedPreceding, -1)  # calendar-bounded
    run = cal.select(
        F.col("TARGET_MONTH").alias("VAL_MONTH"),
        F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("n_train_rows"),
        F.coalesce(F.sum("pos").over(w), F.lit(0)).alias("n_train_pos"),
        F.col("rows").alias("n_val_rows"),
        F.col("pos").alias("n_val_pos"),
        F.col("classes").alias("n_val_classes"),
    )
    out = folds.join(run, "VAL_MONTH")
    ok = (
        (F.col("n_train_rows") > 0)
        & (F.col("n_train_pos") >= min_positives)
        & (F.col("n_val_rows") > 0)
        & (F.col("n_val_classes") >= 2)
    )
    return out.withColumn("eligible", ok)


def pos_weight(eligibility: DataFrame) -> DataFrame:
    """n_neg / n_pos of each fold's training rows; 1.0 without positives."""
    n_pos, n = F.col("n_train_pos"), F.col("n_train_rows")
    return eligibility.select(
        "fold_id",
        "VAL_MONTH",
        F.when(n_pos > 0, (n - n_pos) / n_pos).otherwise(F.lit(1.0)).alias("pos_weight"),
    )

