"""Typed loaders for the domain tables.

Each loader selects a fixed column list, casts to the engine schema, turns
NaN measures into nulls (aggregates then skip them, as pandas does) and derives
the int ``MONTH``.  Time bounds are half-open ranges on the raw ``DATETIME``
column (``>= Y-01-01 AND < (Y+1)-01-01``) so they are pushed into the scan and
no hour of 31 December is lost.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.functions.columns import nan_to_null
from monthpick.functions.months import (
    add_months_int,
    col_month_from_str,
    col_month_of_ts,
    month_start,
    month_str_to_int,
    ntz_literal,
)
from monthpick.functions.predicates import apply_filters
from monthpick.schema import (
    COSTS_COLUMNS,
    PRICES_COLUMNS,
    SIM_DAILY_COLUMNS,
    SIM_MONTHLY_COLUMNS,
    SIM_SIGNALS,
)


def _ts_range(df: DataFrame, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("DATETIME") >= ntz_literal(start))
    if end is not None:
        df = df.where(F.col("DATETIME") < ntz_literal(end))
    return df


def year_ranges(years) -> list[tuple[dt.datetime, dt.datetime]]:
    """Half-open ranges that cover exactly the named years, runs of years merged."""
    out: list[list[int]] = []
    for y in sorted({int(y) for y in years or []}):
        if out and out[-1][1] == y:
            out[-1][1] = y + 1
        else:
            out.append([y, y + 1])
    return [(dt.datetime(a, 1, 1), dt.datetime(b, 1, 1)) for a, b in out]


def _in_years(df: DataFrame, years) -> DataFrame:
    ranges = [(F.col("DATETIME") >= ntz_literal(a)) & (F.col("DATETIME") < ntz_literal(b)) for a, b in year_ranges(years)]
    return df.where(reduce(lambda x, y: x | y, ranges)) if ranges else df


def month_bounds(first: str | int | None, last: str | int | None):
    """Half-open timestamp bound covering months ``first`` .. ``last``."""
    lo = month_start(month_str_to_int(first)) if first is not None else None
    hi = month_start(add_months_int(month_str_to_int(last), 1)) if last is not None else None
    return lo, hi


def load_costs(raw: DataFrame, columns: list[str] | None = None, filters=None) -> DataFrame:
    cols = columns or COSTS_COLUMNS
    df = apply_filters(raw.select(*cols), filters)
    out = []
    for c in cols:
        if c == "EID":
            out.append(F.col("EID").cast("string").alias("EID"))
        elif c == "PEAKID":
            out.append(F.col("PEAKID").cast("int").alias("PEAKID"))
        elif c == "C":
            out.append(nan_to_null("C").cast("double").alias("C"))
        elif c == "MONTH":
            out.append(col_month_from_str(F.col("MONTH").cast("string")).alias("MONTH"))
        else:
            out.append(F.col(c))
    return df.select(*out)


def load_prices(
    raw: DataFrame,
    columns: list[str] | None = None,
    filters=None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    cols = columns or PRICES_COLUMNS
    df = _ts_range(apply_filters(raw.select(*cols), filters), start, end)
    out = []
    for c in cols:
        if c == "EID":
            out.append(F.col("EID").cast("string").alias("EID"))
        elif c == "PEAKID":
            out.append(F.col("PEAKID").cast("int").alias("PEAKID"))
        elif c == "PRICEREALIZED":
            out.append(nan_to_null("PRICEREALIZED").cast("double").alias("PRICEREALIZED"))
        else:
            out.append(F.col(c))
    return df.select(*out, col_month_of_ts("DATETIME").alias("MONTH"))


def load_sim(
    raw: DataFrame,
    price_col: str,
    years=None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    filters=None,
) -> DataFrame:
    """One scan of a simulation table (both scenarios files read once)."""
    cols = SIM_MONTHLY_COLUMNS if price_col == "PSM" else SIM_DAILY_COLUMNS
    df = apply_filters(raw.select(*cols), filters)
    df = _ts_range(_in_years(df, years), start, end)
    measures = [*SIM_SIGNALS, price_col]
    return df.select(
        "SCENARIOID",  # kept in its source type: a cheaper group key than a string
        F.col("EID").cast("string").alias("EID"),
        "DATETIME",
        F.col("PEAKID").cast("int").alias("PEAKID"),
        *[nan_to_null(c).cast("double").alias(c) for c in measures],
        col_month_of_ts("DATETIME").alias("MONTH"),
    )


def load_sim_monthly(raw: DataFrame, years=None, start=None, end=None, filters=None) -> DataFrame:
    return load_sim(raw, "PSM", years, start, end, filters)


def load_sim_daily(raw: DataFrame, years=None, start=None, end=None, filters=None) -> DataFrame:
    return load_sim(raw, "PSD", years, start, end, filters)
