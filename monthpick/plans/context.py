"""Shared inputs of the registered queries: typed domain tables over a scale dir.

Every registered query reads the driver tables through these loaders, so its
work grows with the tables.  Nothing here collects data to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthpick.operators.features import sim_daily_features, sim_monthly_features
from monthpick.operators.labels import compute_profitability
from monthpick.functions.columns import snap
from monthpick.plans.oracle_sql import digits_for
from monthpick.sources.adapters import driver_sources
from monthpick.session import materialize_all
from monthpick.sources.loaders import load_costs, load_prices, load_sim_daily, load_sim_monthly


@dataclass
class Inputs:
    prices: DataFrame
    costs: DataFrame
    sim_monthly: DataFrame
    sim_daily: DataFrame
    _staged: dict | None = None

    def _stage(self, *names: str) -> DataFrame:
        """Stage what is asked for and not yet there; several together are written concurrently."""
        self._staged = self._staged or {}
        plans = {"hist": lambda: self.hist_plan, "sm": lambda: sim_monthly_features(self.sim_monthly), "sd": lambda: sim_daily_features(self.sim_daily)}
        missing = [n for n in names if n not in self._staged]
        if missing:
            self._staged |= dict(zip(missing, materialize_all(*[plans[n]() for n in missing], names=[f"input-{n}" for n in missing])))
        return self._staged[names[0]]

    def stage_all(self) -> Inputs:
        """All three inputs of the feature matrix, written side by side."""
        self._stage("hist", "sm", "sd")
        return self

    @property
    def hist(self) -> DataFrame:
        """Label table as a stage boundary (features and truth read it 2-3 times)."""
        return self._stage("hist")

    @property
    def sm_features(self) -> DataFrame:
        """Staged monthly-sim aggregate."""
        return self._stage("sm")

    @property
    def sd_features(self) -> DataFrame:
        """Staged daily-sim aggregate."""
        return self._stage("sd")

    @property
    def hist_plan(self) -> DataFrame:
        """Label table as a lazy plan, for queries that read it once."""
        return compute_profitability(self.prices, self.costs)


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    raw = driver_sources(spark, sf_dir)
    return Inputs(
        prices=load_prices(raw.prices),
        costs=load_costs(raw.costs),
        sim_monthly=load_sim_monthly(raw.sim_monthly),
        sim_daily=load_sim_daily(raw.sim_daily),
    )


def finish(df: DataFrame) -> DataFrame:
    """Snap doubles the way the oracles do (4 dp for large magnitudes, else 6)."""
    return df.select(
        *[
            snap(n, digits_for(n)).alias(n) if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes
        ]
    )
