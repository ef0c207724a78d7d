"""Conjunctive predicate lists ``[(column, op, value), ...]`` -> one Column.

Comparisons against raw columns with literal values are what Catalyst pushes
into the Parquet scan, so loaders express every bound this way.  String values
on DATETIME become timestamps.  Month values take the type of the MONTH column they meet:
int YYYYMM, or 'YYYY-MM' text (same order) on a raw table that has text.
Unknown operators raise.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthpick.functions.months import month_int_to_str, month_str_to_int, ntz_literal

_BINARY = {
    "==": lambda c, v: c == v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
}


def _literal(col: str, value, text_months: bool):
    if isinstance(value, (list, tuple, set)):
        return [_literal(col, v, text_months) for v in value]
    if col == "DATETIME" and isinstance(value, str):
        return ntz_literal(dt.datetime.fromisoformat(value))
    if col == "MONTH":
        month = month_str_to_int(value)
        return F.lit(month_int_to_str(month) if text_months else month)
    return F.lit(value)


def predicate(filters, text_months: bool = False) -> Column | None:
    """AND of all (col, op, value) triples; None for an empty list."""
    conds = []
    for col, op, value in filters or []:
        c = F.col(col)
        if op == "in":
            conds.append(c.isin(*_literal(col, list(value), text_months)))
        elif op in _BINARY:
            conds.append(_BINARY[op](c, _literal(col, value, text_months)))
        else:
            raise ValueError(f"Unsupported operator: {op}")
    if not conds:
        return None
    return reduce(lambda a, b: a & b, conds)


def apply_filters(df: DataFrame, filters) -> DataFrame:
    cond = predicate(filters, dict(df.dtypes).get("MONTH") == "string")
    return df if cond is None else df.where(cond)
