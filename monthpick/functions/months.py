"""Month codec.

Inside the engine a month is an ``int`` YYYYMM (ordering of ints == ordering of
months); at the API edges it is a ``'YYYY-MM'`` string.  Column helpers are pure
integer / date built-ins so they stay inside whole-stage codegen; the Python
helpers turn driver parameters into literals (so range predicates on the raw
``DATETIME`` column reach the Parquet scan).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- driver side


def month_str_to_int(month: str | int) -> int:
    """'2022-06' -> 202206; ints pass through."""
    if isinstance(month, str):
        return int(month.replace("-", ""))
    return int(month)


def month_int_to_str(month: int) -> str:
    """202206 -> '2022-06'."""
    s = str(int(month))
    return f"{s[:4]}-{s[4:]}"


def add_months_int(month: int, n: int) -> int:
    idx = (month // 100) * 12 + (month % 100) - 1 + n
    return (idx // 12) * 100 + idx % 12 + 1


def prev_month(month: str) -> str:
    """'2022-01' -> '2021-12'."""
    return month_int_to_str(add_months_int(month_str_to_int(month), -1))


def month_range(start: str | int, end: str | int) -> list[str]:
    """Inclusive list of 'YYYY-MM' months."""
    cur, last = month_str_to_int(start), month_str_to_int(end)
    out = []
    while cur <= last:
        out.append(month_int_to_str(cur))
        cur = add_months_int(cur, 1)
    return out


def years_needed(months: list[str]) -> list[int]:
    return sorted({int(m[:4]) for m in months})


def month_start(month: int) -> dt.datetime:
    """First instant of a YYYYMM month (a literal for range predicates)."""
    return dt.datetime(month // 100, month % 100, 1)


def ntz_literal(value: dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal: wall-clock time, no session-time-zone conversion
    (a plain ``lit(datetime)`` goes through the session time zone)."""
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


# ---------------------------------------------------------------- column side


def col_month_from_str(c) -> Column:
    """'YYYY-MM' (or already-int) column -> int YYYYMM."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "-", "").cast("int")


def col_month_to_str(c) -> Column:
    """int YYYYMM column -> 'YYYY-MM'."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2))


def col_month_of_ts(c) -> Column:
    """timestamp column -> int YYYYMM."""
    ts = F.col(c) if isinstance(c, str) else c
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def col_add_months(c, n: int) -> Column:
    """int YYYYMM column shifted by ``n`` calendar months (integer arithmetic)."""
    m = F.col(c) if isinstance(c, str) else c
    idx = F.floor(m / 100) * 12 + (m % 100) - 1 + F.lit(n)
    return (F.floor(idx / 12) * 100 + F.pmod(idx, F.lit(12)) + 1).cast("int")


def col_daily_cutoff_ok(ts_col: str = "DATETIME", days: int = 7) -> Column:
    """Row is on or before day ``days+1`` 00:00 of its own month (inclusive).
    Wall-clock arithmetic only (no time-zone conversion)."""
    ts = F.col(ts_col)
    cutoff = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.lit(days + 1), F.lit(0), F.lit(0), F.lit(0))
    return ts <= cutoff
