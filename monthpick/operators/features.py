"""Point-in-time feature matrix for every target month in one plan.

For target month T (decision month D = T-1):

* ``sm_*``  — simulation means for T from the monthly simulations (their rows
  for month T exist before day 8 of D), plus the population std across the
  per-scenario means of PSM;
* ``sd_*``  — the same from the daily simulations of D, rows on or before
  D-08 00:00 (inclusive);
* ``hist_*_{N}m`` — label statistics over the last N months *present* in the
  label table that are <= D (or <= D-1 with ``hist_through='prior_month'``).

The month is a group key, never a driver loop: the sims are aggregated once
per (MONTH, EID, PEAKID), the labels once per month of a key, and each target's
window is a range frame over the ranks of its key's months.

Scale notes
-----------
* ``agg_sim`` shuffles the (large) simulation tables exactly once, after a
  map-side partial aggregate of sums and counts per (MONTH, EID, PEAKID), with
  the price's sums and counts of each scenario as columns; the scenario std is
  taken over these.  The scenarios are listed first, from their column alone.
  With more than ``SCENARIO_COLUMNS`` of them, a row for each scenario of a key
  is grouped first, which is a second shuffle of the partials.  A hot EID
  holding a third of all rows is collapsed to one partial row per map task.
* The history month map has at most (#target months × N) rows — bounded by the
  calendar, not by the data — and is broadcast.  The global window that ranks
  months runs on distinct months only (hundreds of rows at most).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthpick.functions.columns import rowwise_mean, zero_fill
from monthpick.functions.months import col_add_months, col_daily_cutoff_ok, col_month_to_str
from monthpick.session import materialize, materialize_all
from monthpick.schema import (
    DAILY_CUTOFF_DAYS,
    DEFAULT_LOOKBACK,
    SIM_SIGNALS,
    hist_feature_names,
)

SIM_KEY = ["MONTH", "EID", "PEAKID"]
#: So many scenarios have their price sums as columns of a key's row.
SCENARIO_COLUMNS = 8


def _few_scenarios(sim: DataFrame) -> list | None:
    """Scenarios of ``sim``, if ``SCENARIO_COLUMNS`` hold them (no more than one beyond reaches the driver)."""
    found = sim.select("SCENARIOID").where(F.col("SCENARIOID").isNotNull()).distinct().limit(SCENARIO_COLUMNS + 1).collect()
    return sorted(r[0] for r in found) if len(found) <= SCENARIO_COLUMNS else None


def agg_sim(sim: DataFrame, price_col: str, prefix: str) -> DataFrame:
    """Per (MONTH, EID, PEAKID): null-skipping mean of every signal present and
    of the price, and the population std of the per-scenario price means."""
    measures = [c for c in [*SIM_SIGNALS, price_col] if c in sim.columns]
    with_scen = "SCENARIOID" in sim.columns and price_col in sim.columns
    keyed = sim.where(
        F.col("EID").isNotNull() & F.col("PEAKID").isNotNull() & F.col("MONTH").isNotNull()
    )
    scenarios = _few_scenarios(keyed) if with_scen else []
    if scenarios is not None:
        return _agg_sim_columns(keyed, measures, price_col, prefix, scenarios, with_scen)
    partial = keyed.groupBy(*SIM_KEY, "SCENARIOID").agg(
        *[F.sum(c).alias(f"s_{c}") for c in measures],
        *[F.count(c).alias(f"n_{c}") for c in measures],
    )
    aggs = []
    for c in measures:
        n = F.sum(f"n_{c}")
        aggs.append(F.when(n > 0, F.sum(f"s_{c}") / n).alias(f"{prefix}_{c}_mean"))
    scen_mean = F.when(
        F.col("SCENARIOID").isNotNull() & (F.col(f"n_{price_col}") > 0),
        F.col(f"s_{price_col}") / F.col(f"n_{price_col}"),
    )
    aggs.append(F.stddev_pop(scen_mean).alias(f"{prefix}_{price_col}_scenario_std"))
    return partial.groupBy(*SIM_KEY).agg(*aggs)


def _agg_sim_columns(keyed: DataFrame, measures: list[str], price_col: str, prefix: str, scenarios: list, with_scen: bool) -> DataFrame:
    """``agg_sim`` in one grouping: the price is added up for each scenario, and for rows without one."""
    parts = {c: F.col(c) for c in measures}
    if with_scen:
        price = parts.pop(price_col)
        parts |= {f"p{k}": F.when(F.col("SCENARIOID") == F.lit(s), price) for k, s in enumerate(scenarios)}
        parts["p"] = F.when(F.col("SCENARIOID").isNull(), price)
    grouped = keyed.groupBy(*SIM_KEY).agg(
        *[F.sum(c).alias(f"s_{name}") for name, c in parts.items()],
        *[F.count(c).alias(f"n_{name}") for name, c in parts.items()],
    )
    if with_scen:
        names = [f"p{k}" for k in range(len(scenarios))]
        total = [F.coalesce(F.col(f"s_{p}"), F.lit(0.0)) for p in ("p", *names)]
        count = [F.col(f"n_{p}") for p in ("p", *names)]
        means = [F.when(F.col(f"n_{p}") > 0, F.col(f"s_{p}") / F.col(f"n_{p}")).alias(f"m_{p}") for p in names]
        grouped = grouped.select("*", reduce(add, total).alias(f"s_{price_col}"), reduce(add, count).alias(f"n_{price_col}"), *means)
    out = [F.when(F.col(f"n_{c}") > 0, F.col(f"s_{c}") / F.col(f"n_{c}")).alias(f"{prefix}_{c}_mean") for c in measures]
    if with_scen:
        mean = rowwise_mean([f"m_{p}" for p in names]) if names else F.lit(None).cast("double")
        grouped = grouped.withColumn("m", mean)
        square = [(F.col(f"m_{p}") - F.col("m")) * (F.col(f"m_{p}") - F.col("m")) for p in names]
        grouped = grouped.select("*", *[x.alias(f"d_{p}") for p, x in zip(names, square)])
        std = F.sqrt(rowwise_mean([f"d_{p}" for p in names])) if names else F.lit(None).cast("double")
        out.append(std.alias(f"{prefix}_{price_col}_scenario_std"))
    return grouped.select(*SIM_KEY, *out)


def sim_monthly_features(sim_monthly: DataFrame) -> DataFrame:
    """``sm_*`` features keyed by TARGET (the month the monthly sims describe)."""
    return agg_sim(sim_monthly, "PSM", "sm").withColumnRenamed("MONTH", "TARGET")


def sim_daily_features(sim_daily: DataFrame, cutoff_days: int = DAILY_CUTOFF_DAYS) -> DataFrame:
    """``sd_*`` features of decision month D, keyed by TARGET = D + 1."""
    early = sim_daily.where(col_daily_cutoff_ok("DATETIME", cutoff_days))
    sd = agg_sim(early, "PSD", "sd")
    return sd.withColumn("TARGET", col_add_months("MONTH", 1)).drop("MONTH")


def _month_events(hist_profit: DataFrame, targets: DataFrame, hist_through: str) -> DataFrame:
    """(M, kind, TARGET, c): months present in ``hist_profit`` (kind 0, c: their rank) and window ends of the
    targets (kind 1, c: rank of the last present month at or before the end).

    Built from distinct months only: both are merged in month order with a running count of present months."""
    shift = {"decision_month": -1, "prior_month": -2}[hist_through]
    present = hist_profit.select("MONTH").where(F.col("MONTH").isNotNull()).distinct()
    ends = targets.select("TARGET").distinct().select(
        "TARGET", col_add_months("TARGET", shift).alias("M")
    )
    events = present.select(
        F.col("MONTH").alias("M"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("TARGET")
    ).unionByName(ends.select("M", F.lit(1).alias("kind"), "TARGET"))
    w = Window.orderBy("M", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("c", F.sum(1 - F.col("kind")).over(w))


def hist_month_map(
    hist_profit: DataFrame,
    targets: DataFrame,
    lookback: int = DEFAULT_LOOKBACK,
    hist_through: str = "decision_month",
) -> DataFrame:
    """(TARGET, MONTH): the last ``lookback`` months present in ``hist_profit``
    that are <= the window end (D, or D-1 for ``hist_through='prior_month'``).

    The window is the rank range [c-N+1, c] of present months — equi-joins only,
    no pairs of months are enumerated.
    """
    events = _month_events(hist_profit, targets, hist_through)
    ranked = events.where(F.col("kind") == 0).select(F.col("M").alias("MONTH"), F.col("c").alias("R"))
    reach = events.where((F.col("kind") == 1) & (F.col("c") > 0)).select(
        "TARGET",
        F.explode(F.sequence(F.greatest(F.col("c") - lookback + 1, F.lit(1)), F.col("c"))).alias("R"),
    )
    return reach.join(ranked, "R").select("TARGET", "MONTH")


_KEY = ["EID", "PEAKID"]
_SUMS = ["n_rows", "n_win", "s_win", "n_profit", "s_profit", "n_pr", "s_pr", "n_c", "s_c"]


def _ranks(month_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(MONTH, R): rank of each month of the map; (TARGET, R): rank of the last month of each target's window.

    A window is ``lookback`` neighbouring ranks up to that one (calendar-bounded tables)."""
    months = month_map.select("MONTH").distinct().select("MONTH", F.row_number().over(Window.orderBy("MONTH")).alias("R"))
    ends = month_map.groupBy("TARGET").agg(F.max("MONTH").alias("MONTH")).join(months, "MONTH").select("TARGET", "R")
    return months, ends


def _label_values(hist_profit: DataFrame, months: DataFrame) -> DataFrame:
    """(EID, PEAKID, R) of each label row and its share of what the window statistics add up."""
    h = hist_profit.where(F.col("EID").isNotNull() & F.col("PEAKID").isNotNull())
    h = h.join(F.broadcast(months), "MONTH")  # calendar-bounded
    measures = {"win": F.col("IS_PROFITABLE").cast("double"), "profit": F.col("PROFIT"), "pr": F.col("PR"), "c": F.col("C")}
    shares = [x for name, c in measures.items() for x in (c.isNotNull().cast("long").alias(f"n_{name}"), c.alias(f"s_{name}"))]
    return h.select(*_KEY, "R", F.lit(1).cast("long").alias("n_rows"), *shares)


def _label_sums(hist_profit: DataFrame, months: DataFrame) -> DataFrame:
    """One row for each (EID, PEAKID, R): what the window statistics add up."""
    return _label_values(hist_profit, months).groupBy(*_KEY, "R").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _windowed(rows: DataFrame, lookback: int) -> list:
    """Label statistics over the ``lookback`` ranks up to each row's R, as columns.

    A window's rows are at most ``lookback`` months of one (EID, PEAKID)."""
    w = Window.partitionBy(*_KEY).orderBy("R").rangeBetween(-(lookback - 1), 0)
    total = {c: F.sum(c).over(w) for c in _SUMS}
    names = hist_feature_names(lookback)
    means = [F.when(total[f"n_{k}"] > 0, total[f"s_{k}"] / total[f"n_{k}"]).alias(name) for k, name in zip(("win", "profit", "pr", "c"), names)]
    return [*means, total["n_rows"].alias(names[4])]


def hist_features(
    hist_profit: DataFrame,
    month_map: DataFrame,
    lookback: int = DEFAULT_LOOKBACK,
) -> DataFrame:
    """Label statistics per (TARGET, EID, PEAKID) over each target's window.

    No label row is copied: a target's row stands at the rank of its last month,
    among its key's months, and a range frame reaches back from it.  A month's
    row stands for the targets up to the key's next month.
    """
    months, ends = _ranks(month_map)
    sums = _label_sums(hist_profit, months)
    following = F.lead("R").over(Window.partitionBy(*_KEY).orderBy("R"))
    last = F.least(F.coalesce(following - 1, F.col("R") + lookback - 1), F.col("R") + lookback - 1)
    reach = sums.select(*_KEY, "R", last.alias("last")).select(*_KEY, F.explode(F.sequence("R", "last")).alias("R"))
    wanted = reach.join(F.broadcast(ends), "R").select(*_KEY, "R", "TARGET")
    rows = sums.withColumn("TARGET", F.lit(None).cast("int")).unionByName(wanted, allowMissingColumns=True)
    out = rows.repartition(*_KEY).select("TARGET", *_KEY, *_windowed(rows, lookback))
    return out.where(F.col("TARGET").isNotNull())


def stage_feature_inputs(
    sim_monthly: DataFrame, hist_plan: DataFrame, stage: str | None = None, sim_daily: DataFrame | None = None
):
    """Staged (monthly-sim features, label table[, daily-sim features]): independent
    jobs over the three large inputs, written concurrently."""
    dfs = [sim_monthly_features(sim_monthly), hist_plan]
    names = ["sim-monthly-features", "labels"]
    if sim_daily is not None:
        dfs.append(sim_daily_features(sim_daily))
        names.append("sim-daily-features")
    return tuple(materialize_all(*dfs, mode=stage, names=names))


def feature_matrix(
    sim_monthly: DataFrame,
    sim_daily: DataFrame,
    hist_profit: DataFrame,
    lookback: int = DEFAULT_LOOKBACK,
    hist_through: str = "decision_month",
    keep_target_int: bool = False,
    stage: str | None = None,
    sm_features: DataFrame | None = None,
    sd_features: DataFrame | None = None,
    truth: DataFrame | None = None,
) -> DataFrame:
    """Candidates = keys of the monthly sims for T; daily and history features
    are left-joined; every numeric null becomes 0; ``TARGET_MONTH`` 'YYYY-MM'.

    The target months are exactly the months present in ``sim_monthly`` (bound
    them by loading it with a month range).  The monthly-sim aggregate (keys ×
    months, small next to the raw simulations) is a stage boundary: the list of
    target months is read from it instead of scanning the simulations twice.
    ``hist_profit`` is read twice (present months, window aggregates); pass a
    materialized label table.  ``sm_features`` / ``sd_features`` take already
    staged ``sim_monthly_features`` / ``sim_daily_features`` (see
    ``stage_feature_inputs``).

    All three inputs go through one shuffle on (EID, PEAKID), each row once: there
    the two simulations of a target meet in one row by grouping, and the label
    sums of its window by a range frame over ranks of months.  What a key brings
    to a task is a few rows a month.

    ``truth``: label rows that are left-joined to their target month, in the same
    shuffle; they add the column ``truth`` (IS_PROFITABLE, PROFIT), null without one.
    """
    if sm_features is None:
        sm_features = materialize(sim_monthly_features(sim_monthly), stage, name="sim-monthly-features")
    sm = sm_features
    sd = sd_features if sd_features is not None else sim_daily_features(sim_daily)
    targets = sm.select("TARGET").distinct()
    # a row for each present month and target
    events = materialize(_month_events(hist_profit, targets, hist_through), stage, name="months")
    months = events.where("kind = 0").select(F.col("M").alias("MONTH"), F.col("c").cast("int").alias("R"))
    ends = events.where("kind = 1").select("TARGET", F.col("c").cast("int").alias("R"))
    # a label row stands for itself where truths are collected; otherwise a key's labels of a month are added up before
    labels = (_label_sums if truth is None else _label_values)(hist_profit, months)
    sm_cols, sd_cols = ([c for c in d.columns if c not in ("TARGET", *_KEY)] for d in (sm, sd))
    rows = sm.withColumn("is_candidate", F.lit(True)).unionByName(sd, allowMissingColumns=True)
    rows = rows.unionByName(labels.withColumnRenamed("R", "label_rank"), allowMissingColumns=True)
    if truth is not None:
        known = truth.where(F.col("EID").isNotNull() & F.col("PEAKID").isNotNull() & F.col("MONTH").isNotNull())
        known = known.select(F.col("MONTH").alias("TARGET"), *_KEY, F.struct("IS_PROFITABLE", "PROFIT").alias("truth"))
        rows = rows.unionByName(known, allowMissingColumns=True)
    # the rows of a target become one, and those of a label month; a key's labels of a month are one unless its costs repeat
    values = [F.max(c).alias(c) for c in ("is_candidate", *sm_cols, *sd_cols)] + [F.sum(c).alias(c) for c in _SUMS]
    found = [] if truth is None else [F.collect_list("truth").alias("truths")]
    one = rows.repartition(*_KEY).groupBy(*_KEY, "TARGET", "label_rank").agg(*values, *found)
    # calendar-bounded; a target without a window stands before all months
    one = one.join(F.broadcast(ends), "TARGET", "left").withColumn("R", F.coalesce("label_rank", "R", F.lit(0)))
    more = [] if truth is None else ["truths"]
    m = one.select("TARGET", *_KEY, "is_candidate", *more, *sm_cols, *sd_cols, *_windowed(one, lookback)).where("is_candidate").drop("is_candidate")
    features = [c for c in m.columns if c not in ("TARGET", *_KEY, *more)]
    m = zero_fill(m, features)
    cols = ["EID", "PEAKID", *features, col_month_to_str("TARGET").alias("TARGET_MONTH")]
    if keep_target_int:
        cols.append("TARGET")
    return m.select(*cols, *[F.explode_outer(c).alias("truth") for c in more])
