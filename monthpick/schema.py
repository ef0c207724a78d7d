"""Schemas, column lists and constants.

The values under "Fixed values" must equal the reference's for results to
match; they are stated plainly and in their natural order.
"""

from __future__ import annotations

import re

import numpy as np

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

# simulation signals (order as in the source schema)
SIM_SIGNALS = [
    "ACTIVATIONLEVEL",
    "WINDIMPACT",
    "SOLARIMPACT",
    "HYDROIMPACT",
    "NONRENEWBALIMPACT",
    "EXTERNALIMPACT",
    "LOADIMPACT",
    "TRANSMISSIONOUTAGEIMPACT",
]

# composite-score weights; keys are signals of the candidate pool
DEFAULT_WEIGHTS = {
    "sm_PSM_mean": 0.35,
    "sm_ACTIVATIONLEVEL_mean": 0.25,
    "hist_profit_rate": 0.20,
    "hist_mean_profit": 0.15,
    "scenario_agreement": 0.05,
}

DEFAULT_TARGET_K = 50
MIN_K = 10
MAX_K = 100
DEFAULT_LOOKBACK = 6
MIN_TRAIN_MONTHS = 6
MIN_TRAIN_POSITIVES = 5
DAILY_CUTOFF_DAYS = 7  # daily sims up to and including day 8 00:00 of the decision month
SEED = 42
INITIAL_THRESHOLD = 0.3
DEFAULT_THRESHOLD = 0.5  # returned by the sweep when no threshold scores above 0

PEAK_TYPES = {0: "OFF", 1: "ON"}

# model feature list (order as used by every model)
MODEL_FEATURES = [
    "sm_ACTIVATIONLEVEL_mean",
    "sm_PSM_mean",
    "sm_PSM_scenario_std",
    "sm_WINDIMPACT_mean",
    "sm_SOLARIMPACT_mean",
    "sm_HYDROIMPACT_mean",
    "sm_NONRENEWBALIMPACT_mean",
    "sm_EXTERNALIMPACT_mean",
    "sm_LOADIMPACT_mean",
    "sm_TRANSMISSIONOUTAGEIMPACT_mean",
    "sd_ACTIVATIONLEVEL_mean",
    "sd_PSD_mean",
    "sd_PSD_scenario_std",
    "sd_WINDIMPACT_mean",
    "sd_SOLARIMPACT_mean",
    "sd_HYDROIMPACT_mean",
    "hist_profit_rate_6m",
    "hist_mean_profit_6m",
    "hist_mean_pr_6m",
    "hist_mean_c_6m",
    "hist_months_active_6m",
    "PEAKID",
]


def sweep_thresholds() -> list[float]:
    """Threshold grid of the sweep: start 0.05, step 0.05, stop before 0.95."""
    return [float(t) for t in np.arange(0.05, 0.95, 0.05)]


# --------------------------------------------------------------------------
# Schemas of the logical tables
# --------------------------------------------------------------------------

KEY = ["EID", "MONTH", "PEAKID"]
MATRIX_KEY = ["TARGET_MONTH", "EID", "PEAKID"]

PRICES_COLUMNS = ["EID", "DATETIME", "PEAKID", "PRICEREALIZED"]
COSTS_COLUMNS = ["EID", "MONTH", "PEAKID", "C"]


def sim_columns(price_col: str) -> list[str]:
    return ["SCENARIOID", "EID", "DATETIME", "PEAKID", *SIM_SIGNALS, price_col]


SIM_MONTHLY_COLUMNS = sim_columns("PSM")
SIM_DAILY_COLUMNS = sim_columns("PSD")


def hist_feature_names(lookback: int) -> list[str]:
    return [
        f"hist_profit_rate_{lookback}m",
        f"hist_mean_profit_{lookback}m",
        f"hist_mean_pr_{lookback}m",
        f"hist_mean_c_{lookback}m",
        f"hist_months_active_{lookback}m",
    ]


def sim_feature_names(prefix: str, price_col: str) -> list[str]:
    return [f"{prefix}_{c}_mean" for c in [*SIM_SIGNALS, price_col]] + [
        f"{prefix}_{price_col}_scenario_std"
    ]


def matrix_feature_names(lookback: int = DEFAULT_LOOKBACK) -> list[str]:
    return (
        sim_feature_names("sm", "PSM")
        + sim_feature_names("sd", "PSD")
        + hist_feature_names(lookback)
    )


def lookbacks(columns) -> list[int]:
    """Lookbacks of the history features in a frame's columns, ascending."""
    found = (re.fullmatch(r"hist_\w+_(\d+)m", c) for c in columns)
    return sorted({int(m[1]) for m in found if m})


def model_features(lookback: int = DEFAULT_LOOKBACK) -> list[str]:
    """The model feature list with the history features of a lookback."""
    names = dict(zip(hist_feature_names(DEFAULT_LOOKBACK), hist_feature_names(lookback)))
    return [names.get(c, c) for c in MODEL_FEATURES]


def available_features(columns, features=None) -> list[str]:
    """Model features present in a frame's columns (metadata only), with whatever lookback they have."""
    cols = set(columns)
    wanted = features or list(dict.fromkeys(c for n in lookbacks(columns) or [DEFAULT_LOOKBACK] for c in model_features(n)))
    return [c for c in wanted if c in cols]
