"""Month spine: one row per target month, with its decision month.

The spine is derived from the data (calendar months between the first and last
month of a table), so a job sized by its inputs never needs a driver list.
Its size is bounded by the calendar (12 rows per year).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.functions.months import col_add_months, col_month_of_ts, col_month_to_str


def calendar_spine(df: DataFrame, ts_col: str = "DATETIME") -> DataFrame:
    """Every calendar month from min to max of ``ts_col`` (inclusive)."""
    first_day = F.trunc(F.to_date(F.col(ts_col)), "month")  # wall-clock, no time zone
    bounds = df.agg(F.min(first_day).alias("lo"), F.max(first_day).alias("hi"))
    months = bounds.select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("d")
    ).select(col_month_of_ts("d").alias("TARGET"))
    return spine_columns(months)


def spine_columns(months: DataFrame) -> DataFrame:
    """(TARGET_MONTH, TARGET, DECISION, DECISION_MONTH, YEAR) from int TARGET."""
    return months.select(
        col_month_to_str("TARGET").alias("TARGET_MONTH"),
        "TARGET",
        col_add_months("TARGET", -1).alias("DECISION"),
        col_month_to_str(col_add_months("TARGET", -1)).alias("DECISION_MONTH"),
        F.floor(F.col("TARGET") / 100).cast("int").alias("YEAR"),
    )
