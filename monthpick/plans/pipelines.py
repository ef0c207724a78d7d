"""End-to-end jobs: rule-based selection (``run``) and its backtest.

Both are one lazy plan over all target months.  Month bounds become half-open
ranges on the raw DATETIME column (pushed into the scan): monthly sims for the
target range, daily sims for the decision range.  The label table is built
once and serves history features (<= decision month, enforced by the month map)
and, in the backtest, the truth of each target month.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from monthpick.functions.months import prev_month
from monthpick.operators.evaluation import backtest_monthly, backtest_summary
from monthpick.operators.features import feature_matrix, stage_feature_inputs
from monthpick.operators.labels import base_rate_describe, compute_profitability
from monthpick.operators.selection import select_opportunities
from monthpick.schema import DEFAULT_LOOKBACK, DEFAULT_TARGET_K
from monthpick.session import materialize
from monthpick.sources.adapters import RawSources
from monthpick.sources.loaders import (
    load_costs,
    load_prices,
    load_sim_daily,
    load_sim_monthly,
    month_bounds,
)


@dataclass
class Loaded:
    prices: DataFrame
    costs: DataFrame
    sim_monthly: DataFrame
    sim_daily: DataFrame
    hist: DataFrame
    sm_features: DataFrame
    sd_features: DataFrame


def load_for_targets(
    raw: RawSources, start: str | None = None, end: str | None = None, stage: str | None = None, truth: bool = False
) -> Loaded:
    """Typed inputs bounded to the target range [start, end] (None = open).

    Labels end at the decision month of ``end``, as no history feature reads
    later ones; with ``truth`` at ``end`` itself, for evaluation.  Their first
    month stays open: history is counted in months that are present.

    The label table (monthly grain) is used by history features and by the
    truth side of evaluation, so it is a stage boundary (``materialize``).
    """
    sm_lo, sm_hi = month_bounds(start, end)
    sd_lo, sd_hi = month_bounds(
        prev_month(start) if start else None, prev_month(end) if end else None
    )
    last_label = (end if truth else prev_month(end)) if end else None
    prices = load_prices(raw.prices, end=month_bounds(None, last_label)[1])
    costs = load_costs(raw.costs, filters=[("MONTH", "<=", last_label)] if last_label else None)
    sim_monthly = load_sim_monthly(raw.sim_monthly, start=sm_lo, end=sm_hi)
    sim_daily = load_sim_daily(raw.sim_daily, start=sd_lo, end=sd_hi)
    # the stage tables are independent jobs: written concurrently
    sm_features, hist, sd_features = stage_feature_inputs(
        sim_monthly, compute_profitability(prices, costs), stage, sim_daily=sim_daily
    )
    return Loaded(
        prices=prices,
        costs=costs,
        sim_monthly=sim_monthly,
        sim_daily=sim_daily,
        hist=hist,
        sm_features=sm_features,
        sd_features=sd_features,
    )


def run(
    raw: RawSources,
    start: str | None = None,
    end: str | None = None,
    target_k: int = DEFAULT_TARGET_K,
    lookback: int = DEFAULT_LOOKBACK,
    weights: dict | None = None,
    hist_through: str = "decision_month",
) -> DataFrame:
    """Selections (TARGET_MONTH, PEAK_TYPE, EID) for every target month."""
    d = load_for_targets(raw, start, end)
    matrix = materialize(
        feature_matrix(d.sim_monthly, d.sim_daily, d.hist, lookback, hist_through, sm_features=d.sm_features, sd_features=d.sd_features)
    )
    return select_opportunities(matrix, target_k, weights)


@dataclass
class BacktestResult:
    monthly: DataFrame
    summary: DataFrame
    base_rates: DataFrame
    selections: DataFrame
    hist: DataFrame


def run_backtest(
    raw: RawSources,
    start: str | None = None,
    end: str | None = None,
    target_k: int = DEFAULT_TARGET_K,
    lookback: int = DEFAULT_LOOKBACK,
) -> BacktestResult:
    d = load_for_targets(raw, start, end, truth=True)
    matrix = materialize(feature_matrix(d.sim_monthly, d.sim_daily, d.hist, lookback, sm_features=d.sm_features, sd_features=d.sd_features))
    selections = materialize(select_opportunities(matrix, target_k))
    monthly = backtest_monthly(selections, d.hist)
    return BacktestResult(
        monthly=monthly,
        summary=backtest_summary(monthly),
        base_rates=base_rate_describe(d.hist),
        selections=selections,
        hist=d.hist,
    )
