"""Registered queries: sinks and file sources.

Each writes to a fresh path under the shared checkpoint folder and reads the
result back, so the returned rows are what a downstream reader would see; the
CSV, dataset and per-year-file round trips are checked against the oracle of
the data they carry.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from monthpick.functions.columns import snap
from monthpick.functions.months import years_needed
from monthpick.operators.dataset import labeled_dataset
from monthpick.plans.context import finish, inputs
from monthpick.plans.oracle_sql import ctes, month_str, rnd
from monthpick.plans.q_features import FEATS, LABELED_SQL
from monthpick.plans.q_labels import LOAD_SIM_DAILY_SQL, scen_str
from monthpick.plans.q_selection import sel_ctes
from monthpick.plans.pipelines import run
from monthpick.plans.refresh import refresh_dataset
from monthpick.plans.registry import query
from monthpick.session import materialize, scratch_path
from monthpick.sources.adapters import driver_sources
from monthpick.sources.sinks import (
    bulk_convert,
    read_dataset,
    read_opportunities_csv,
    read_year_files,
    write_dataset,
    write_opportunities_csv,
)


@query("csv_roundtrip", sel_ctes(50, 0.0) + "SELECT * FROM sel")
def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "opportunities-csv")
    write_opportunities_csv(run(driver_sources(spark, sf_dir)), path)
    return read_opportunities_csv(spark, path)


@query("dataset_roundtrip", LABELED_SQL)
def q_dataset_roundtrip(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    path = scratch_path(spark, "dataset")
    write_dataset(labeled_dataset(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features), path)
    return finish(read_dataset(spark, path))


_FLOATS = [f for f in FEATS if not f.startswith("hist_months_active")]


@query(
    "dataset_float32",
    ctes("labeled")
    + "SELECT TARGET_MONTH, EID, PEAKID, hist_months_active_6m, IS_PROFITABLE_L AS IS_PROFITABLE, "
    + ", ".join(rnd(f"CAST(CAST({f} AS FLOAT) AS DOUBLE)", 2, f) for f in _FLOATS)
    + ", 'float' AS kind FROM labeled",
)
def q_dataset_float32(spark, sf_dir):
    """The dataset written with single-precision measures and read back."""
    i = inputs(spark, sf_dir).stage_all()
    path = scratch_path(spark, "dataset")
    write_dataset(labeled_dataset(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features), path, float32=True)
    back = read_dataset(spark, path)
    kinds = {t for c, t in back.dtypes if c in _FLOATS}
    values = [snap(F.col(f).cast("double"), 2).alias(f) for f in _FLOATS]
    return back.select("TARGET_MONTH", "EID", "PEAKID", "hist_months_active_6m", "IS_PROFITABLE", *values, F.lit(",".join(sorted(kinds))).alias("kind"))


@query("dataset_refresh", LABELED_SQL)
def q_dataset_refresh(spark, sf_dir):
    """A dataset built from inputs one of whose label months is wrong, then
    refreshed with the right ones: the months that follow from it are built again."""
    i = inputs(spark, sf_dir)
    path = scratch_path(spark, "dataset")
    costs = materialize(i.costs, name="costs")  # a view that joins lineitem with orders; read for the months and by each digest and build
    months = [r[0] for r in costs.select("MONTH").where("MONTH IS NOT NULL").distinct().orderBy("MONTH").collect()]  # calendar-bounded
    wrong = costs.withColumn("C", F.col("C") + F.when(F.col("MONTH") == months[len(months) // 2], 1000.0).otherwise(0.0))
    refresh_dataset(spark, path, i.prices, wrong, i.sim_monthly, i.sim_daily)
    refresh_dataset(spark, path, i.prices, costs, i.sim_monthly, i.sim_daily)
    return finish(read_dataset(spark, path))


@query(
    "bulk_convert",
    ctes("prices", "costs")
    + f"SELECT 'prices' AS source, EID, strftime(DATETIME, '%Y-%m-%d') AS at, PEAKID, {rnd('PRICEREALIZED', 4, 'amount')} FROM prices "
    f"UNION ALL SELECT 'costs', EID, {month_str('MONTH')}, PEAKID, {rnd('C', 4, 'amount')} FROM costs",
)
def q_bulk_convert(spark, sf_dir):
    """Domain tables written as Parquet (two folders), converted to CSV; both
    are read back with their types."""
    base = scratch_path(spark, "convert")
    raw = driver_sources(spark, sf_dir)
    raw.prices.write.parquet(os.path.join(base, "in", "prices", "prices.parquet"))
    raw.costs.write.parquet(os.path.join(base, "in", "costs", "costs.parquet"))
    outs = bulk_convert(spark, os.path.join(base, "in"), os.path.join(base, "out"))
    back = lambda name, schema: spark.read.option("header", True).schema(schema).csv([o for o in outs if o.endswith(f"/{name}.csv")])
    prices = back("prices", raw.prices.schema).select(F.lit("prices").alias("source"), "EID", F.date_format("DATETIME", "yyyy-MM-dd").alias("at"), "PEAKID", F.col("PRICEREALIZED").alias("amount"))
    costs = back("costs", raw.costs.schema).select(F.lit("costs").alias("source"), "EID", F.col("MONTH").alias("at"), "PEAKID", F.col("C").alias("amount"))
    return prices.unionByName(costs).select("source", "EID", "at", "PEAKID", snap("amount", 4).alias("amount"))


@query("year_file_scan", LOAD_SIM_DAILY_SQL)
def q_year_file_scan(spark, sf_dir):
    """Daily sims written one Parquet file set per year (``sim_daily_<year>``),
    then read back for the years the data covers, selected by file name."""
    base = scratch_path(spark, "year-files")
    i = inputs(spark, sf_dir)
    sd = i.sim_daily.withColumn("YEAR", F.year("DATETIME"))
    sd.write.partitionBy("YEAR").parquet(os.path.join(base, "by_year"))
    by_year = spark.read.parquet(os.path.join(base, "by_year"))
    years = years_needed([f"{r[0]}-01" for r in by_year.select("YEAR").distinct().collect()])  # calendar-bounded

    def write(y: int) -> None:
        by_year.where(F.col("YEAR") == y).drop("YEAR").write.parquet(os.path.join(base, "flat", f"sim_daily_{y}.parquet"))

    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(write, years))
    return finish(scen_str(read_year_files(spark, os.path.join(base, "flat"), years)))
