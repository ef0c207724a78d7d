"""Registered queries: sources, month codec, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthpick.functions.months import col_add_months, col_month_from_str, col_month_to_str
from monthpick.functions.predicates import apply_filters
from monthpick.operators.labels import base_rate_describe, monthly_pr, profitability_summary
from monthpick.plans.context import finish, inputs
from monthpick.plans.oracle_sql import ctes, month_of, month_str, prev_month, rnd, rounded
from monthpick.plans.registry import query
from monthpick.schema import SIM_SIGNALS
from monthpick.sources.adapters import driver_sources
from monthpick.sources.loaders import load_costs, load_sim_daily

SIM_COLS = ["SCENARIOID", "EID", "DATETIME", "PEAKID"]


def scen_str(df):
    return df.withColumn("SCENARIOID", F.col("SCENARIOID").cast("string"))
SIG = rounded(SIM_SIGNALS)

# the reference's per-year load, as a predicate list on the raw columns
FILTERS = [("DATETIME", ">=", "1997-01-01"), ("DATETIME", "<", "1998-01-01"), ("PEAKID", "!=", 2)]


@query(
    "filter_list",
    ctes("sim_daily")
    + f"SELECT {', '.join(SIM_COLS)}, {SIG}, {rounded(['PSD'])}, MONTH FROM sim_daily "
    "WHERE DATETIME >= TIMESTAMP '1997-01-01' AND DATETIME < TIMESTAMP '1998-01-01' AND PEAKID <> 2",
)
def q_filter_list(spark, sf_dir):
    raw = driver_sources(spark, sf_dir)
    return finish(scen_str(load_sim_daily(apply_filters(raw.sim_daily, FILTERS))))


@query(
    "filter_costs_month",
    ctes("costs") + f"SELECT EID, MONTH, PEAKID, {rounded(['C'])} FROM costs WHERE MONTH >= 199703 AND MONTH < 199809",
)
def q_filter_costs_month(spark, sf_dir):
    """Month bounds on the raw text column: compared as text, so they reach the scan."""
    raw = driver_sources(spark, sf_dir)
    return finish(load_costs(raw.costs, filters=[("MONTH", ">=", "1997-03"), ("MONTH", "<", "1998-09")]))


@query(
    "filter_in",
    ctes("costs") + f"SELECT EID, MONTH, PEAKID, {rounded(['C'])} FROM costs WHERE MONTH IN (199701, 199803) AND PEAKID = 1",
)
def q_filter_in(spark, sf_dir):
    raw = driver_sources(spark, sf_dir)
    return finish(load_costs(raw.costs, filters=[("MONTH", "in", ["1997-01", 199803]), ("PEAKID", "=", 1)]))


@query(
    "load_years_gap",
    ctes("sim_daily")
    + f"SELECT {', '.join(SIM_COLS)}, {SIG}, {rounded(['PSD'])}, MONTH FROM sim_daily WHERE year(DATETIME) IN (1996, 1999, 2000)",
)
def q_load_years_gap(spark, sf_dir):
    """A year list with a gap reads the named years only."""
    return finish(scen_str(load_sim_daily(driver_sources(spark, sf_dir).sim_daily, years=[2000, 1996, 1999])))


@query(
    "load_costs",
    ctes("costs") + f"SELECT EID, MONTH, PEAKID, {rounded(['C'])} FROM costs",
)
def q_load_costs(spark, sf_dir):
    return finish(inputs(spark, sf_dir).costs)


@query(
    "load_prices",
    ctes("prices") + f"SELECT EID, DATETIME, PEAKID, {rounded(['PRICEREALIZED'])}, MONTH FROM prices",
)
def q_load_prices(spark, sf_dir):
    return finish(inputs(spark, sf_dir).prices)


@query(
    "load_sim_monthly",
    ctes("sim_monthly") + f"SELECT {', '.join(SIM_COLS)}, {SIG}, {rounded(['PSM'])}, MONTH FROM sim_monthly",
)
def q_load_sim_monthly(spark, sf_dir):
    return finish(scen_str(inputs(spark, sf_dir).sim_monthly))


LOAD_SIM_DAILY_SQL = (
    ctes("sim_daily") + f"SELECT {', '.join(SIM_COLS)}, {SIG}, {rounded(['PSD'])}, MONTH FROM sim_daily"
)


@query("load_sim_daily", LOAD_SIM_DAILY_SQL)
def q_load_sim_daily(spark, sf_dir):
    return finish(scen_str(inputs(spark, sf_dir).sim_daily))


@query(
    "month_codec",
    ctes("costs_raw")
    + f"""SELECT MONTH_STR, MONTH_INT, {month_str('MONTH_INT')} AS MONTH_BACK,
       {month_str(prev_month('MONTH_INT'))} AS PREV_MONTH
FROM (SELECT DISTINCT MONTH AS MONTH_STR, CAST(replace(MONTH, '-', '') AS INTEGER) AS MONTH_INT
      FROM costs_raw) x""",
)
def q_month_codec(spark, sf_dir):
    raw = driver_sources(spark, sf_dir)
    m = raw.costs.select(F.col("MONTH").alias("MONTH_STR")).distinct()
    m = m.withColumn("MONTH_INT", col_month_from_str("MONTH_STR"))
    return m.select(
        "MONTH_STR",
        "MONTH_INT",
        col_month_to_str("MONTH_INT").alias("MONTH_BACK"),
        col_month_to_str(col_add_months("MONTH_INT", -1)).alias("PREV_MONTH"),
    )


@query(
    "month_spine",
    ctes("sim_monthly")
    + f"""SELECT {month_str('T')} AS TARGET_MONTH, T AS TARGET, {prev_month('T')} AS DECISION,
       {month_str(prev_month('T'))} AS DECISION_MONTH, CAST(T // 100 AS INTEGER) AS YEAR
FROM (SELECT {month_of('d')} AS T
      FROM (SELECT unnest(generate_series(min(date_trunc('month', DATETIME)),
                                          max(date_trunc('month', DATETIME)), INTERVAL 1 MONTH)) AS d
            FROM sim_monthly) g) s""",
)
def q_month_spine(spark, sf_dir):
    from monthpick.operators.spine import calendar_spine

    return calendar_spine(inputs(spark, sf_dir).sim_monthly)


@query(
    "monthly_pr",
    ctes("monthly_pr") + f"SELECT EID, MONTH, PEAKID, {rounded(['PR'])} FROM monthly_pr",
)
def q_monthly_pr(spark, sf_dir):
    return finish(monthly_pr(inputs(spark, sf_dir).prices))


@query(
    "profitability",
    ctes("hist")
    + f"SELECT EID, MONTH, PEAKID, {rounded(['PR', 'C', 'PROFIT'])}, IS_PROFITABLE FROM hist",
)
def q_profitability(spark, sf_dir):
    return finish(inputs(spark, sf_dir).hist_plan)


_SUMMARY = """SELECT MONTH, PEAKID, count(EID) AS total_opportunities,
       CAST(sum(CAST(IS_PROFITABLE AS INTEGER)) AS BIGINT) AS profitable,
       count(EID) AS n_eid
FROM hist GROUP BY 1, 2"""


@query(
    "profitability_summary",
    ctes("hist", extra=[("summary", _SUMMARY)])
    + "SELECT MONTH, PEAKID, total_opportunities, profitable, "
    f"{rnd('profitable / total_opportunities', 6, 'profit_rate')} FROM summary",
)
def q_profitability_summary(spark, sf_dir):
    return finish(profitability_summary(inputs(spark, sf_dir).hist_plan))


@query(
    "base_rate_describe",
    ctes("hist", extra=[("summary", _SUMMARY)])
    + f"""SELECT PEAKID, count(r) AS count, {rnd('avg(r)', 6, 'mean')}, {rnd('stddev_samp(r)', 6, 'std')},
       {rnd('min(r)', 6, 'min')}, {rnd('quantile_cont(r, 0.25)', 6, 'p25')},
       {rnd('quantile_cont(r, 0.5)', 6, 'p50')}, {rnd('quantile_cont(r, 0.75)', 6, 'p75')},
       {rnd('max(r)', 6, 'max')}
FROM (SELECT PEAKID, profitable / total_opportunities AS r FROM summary) s GROUP BY 1""",
)
def q_base_rate_describe(spark, sf_dir):
    return finish(base_rate_describe(inputs(spark, sf_dir).hist_plan))

