"""Adapter views: the four domain tables expressed over the driver's tables.

The driver ships TPC-H-like tables; the domain tables (hourly prices, monthly
costs, monthly and daily scenario simulations) are column expressions over
``lineitem`` (and ``orders`` for the cost month).  The same expressions are used
by the SQL oracles, so both engines start from identical inputs.

Every view is lazy: column pruning and pushed filters still reach the
``lineitem`` scan (``DATETIME`` is a plain alias of ``l_shipdate`` in prices and
daily sims, so a range on it becomes a Parquet row-group filter).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cost factor of the adapter (C = 4 * sum of extended price)
COST_FACTOR = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class RawSources:
    """Domain tables in their on-disk schema (costs.MONTH is 'YYYY-MM')."""

    prices: DataFrame
    costs: DataFrame
    sim_monthly: DataFrame
    sim_daily: DataFrame


def _eid():
    return F.concat(F.lit("EID_"), F.lpad(F.col("l_suppkey").cast("string"), 4, "0"))


def _peakid():
    return F.when(F.col("l_linestatus") == "O", 1).otherwise(0).cast("int")


def prices_view(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _eid().alias("EID"),
        F.col("l_shipdate").alias("DATETIME"),
        _peakid().alias("PEAKID"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("PRICEREALIZED"),
    )


def costs_view(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select(
        "l_orderkey", _eid().alias("EID"), _peakid().alias("PEAKID"), "l_extendedprice"
    )
    od = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.date_format("o_orderdate", "yyyy-MM").alias("MONTH"),
    )
    return (
        li.join(od, "l_orderkey")
        .groupBy("EID", "MONTH", "PEAKID")
        .agg((F.lit(COST_FACTOR) * F.sum("l_extendedprice")).alias("C"))
    )


def _sim_view(lineitem: DataFrame, price_col: str, shift_month: bool) -> DataFrame:
    ts = F.col("l_shipdate")
    if shift_month:
        # month M's rows stand in as the forecast of M+1 (no leakage)
        ts = ts + F.expr("INTERVAL 1 MONTH")
    return lineitem.select(
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("SCENARIOID"),
        _eid().alias("EID"),
        ts.alias("DATETIME"),
        _peakid().alias("PEAKID"),
        F.col("l_quantity").alias("ACTIVATIONLEVEL"),
        F.col("l_discount").alias("WINDIMPACT"),
        F.col("l_tax").alias("SOLARIMPACT"),
        (F.col("l_discount") - F.col("l_tax")).alias("HYDROIMPACT"),
        (F.col("l_quantity") * F.col("l_discount")).alias("NONRENEWBALIMPACT"),
        (F.col("l_quantity") * F.col("l_tax")).alias("EXTERNALIMPACT"),
        F.col("l_linenumber").cast("double").alias("LOADIMPACT"),
        (-F.col("l_discount")).alias("TRANSMISSIONOUTAGEIMPACT"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias(price_col),
    )


def sim_monthly_view(lineitem: DataFrame) -> DataFrame:
    return _sim_view(lineitem, "PSM", shift_month=True)


def sim_daily_view(lineitem: DataFrame) -> DataFrame:
    return _sim_view(lineitem, "PSD", shift_month=False)


def driver_sources(spark: SparkSession, sf_dir: str) -> RawSources:
    """The four domain tables over ``{sf_dir}/lineitem|orders.parquet``."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    return RawSources(
        prices=prices_view(lineitem),
        costs=costs_view(lineitem, orders),
        sim_monthly=sim_monthly_view(lineitem),
        sim_daily=sim_daily_view(lineitem),
    )
