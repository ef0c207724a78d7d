"""Realized profitability labels: PR = sum of hourly prices, PROFIT = PR - C.

Scale notes: the hourly price table is the large input.  ``monthly_pr`` is a
hash aggregate with a map-side partial step, so a hot EID is collapsed to one
row per map task before the shuffle.  The full outer join with costs then runs
on (EID, MONTH, PEAKID)-keyed monthly rows — both sides are shuffled on the same
key order so later joins/aggregations on that key can reuse the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.schema import KEY


def monthly_pr(prices: DataFrame) -> DataFrame:
    """Σ PRICEREALIZED per (EID, MONTH, PEAKID); null keys are dropped."""
    return (
        prices.where(F.col("EID").isNotNull() & F.col("MONTH").isNotNull() & F.col("PEAKID").isNotNull())
        .groupBy(*KEY)
        .agg(F.coalesce(F.sum("PRICEREALIZED"), F.lit(0.0)).alias("PR"))
    )


def compute_profitability(prices: DataFrame, costs: DataFrame) -> DataFrame:
    """Full outer join of monthly PR and costs; a missing side counts as 0.

    Costs are not de-duplicated: a duplicated cost key fans out, as in the
    reference (see ``cost_duplicates`` for the check).
    """
    pr = monthly_pr(prices)
    c = costs.select(*KEY, "C")
    merged = pr.join(c, KEY, "full_outer")
    pr_v = F.coalesce(F.col("PR"), F.lit(0.0))
    c_v = F.coalesce(F.col("C"), F.lit(0.0))
    return merged.select(
        *KEY,
        pr_v.alias("PR"),
        c_v.alias("C"),
        (pr_v - c_v).alias("PROFIT"),
        ((pr_v - c_v) > 0).alias("IS_PROFITABLE"),
    )


def cost_duplicates(costs: DataFrame) -> DataFrame:
    """Cost keys that occur more than once (they fan out in the label join)."""
    return costs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def profitability_summary(profit: DataFrame) -> DataFrame:
    """Per (MONTH, PEAKID): count of EIDs, profitable count, profit rate."""
    return (
        profit.groupBy("MONTH", "PEAKID")
        .agg(
            F.count("EID").alias("total_opportunities"),
            F.sum(F.col("IS_PROFITABLE").cast("long")).alias("profitable"),
        )
        .withColumn("profit_rate", F.col("profitable") / F.col("total_opportunities"))
    )


def describe_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """pandas-style ``describe`` of ``value`` per ``group``.

    count, mean, sample std, min, 25/50/75 % (linear interpolation — Spark's
    exact ``percentile`` interpolates like pandas), max.
    """
    v = F.col(value)
    return df.groupBy(group).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.percentile(v, 0.25).alias("p25"),
        F.percentile(v, 0.5).alias("p50"),
        F.percentile(v, 0.75).alias("p75"),
        F.max(v).alias("max"),
    )


def base_rate_describe(profit: DataFrame) -> DataFrame:
    """Distribution of monthly profit rate per PEAKID."""
    return describe_by(profitability_summary(profit), "PEAKID", "profit_rate")
