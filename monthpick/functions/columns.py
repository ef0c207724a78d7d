"""Column-level helpers shared by the operators (all JVM built-ins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthpick.schema import PEAK_TYPES


def peak_type(c: str = "PEAKID") -> Column:
    """0 -> 'OFF', 1 -> 'ON', anything else -> null."""
    expr = None
    for k, v in PEAK_TYPES.items():
        expr = (F.when if expr is None else expr.when)(F.col(c) == k, F.lit(v))
    return expr


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1_from(precision: Column, recall: Column) -> Column:
    s = precision + recall
    return F.when(s > 0, 2 * precision * recall / s).otherwise(F.lit(0.0))


def nan_to_null(c: str) -> Column:
    """NaN -> null so aggregates skip it (pandas treats NaN as missing)."""
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def zero_filled(c: str) -> Column:
    """Column as double with null and NaN as 0."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null (and NaN) numeric columns -> 0."""
    exprs = []
    fill = set(cols)
    for name, dtype in df.dtypes:
        if name in fill and dtype in ("double", "float"):
            exprs.append(F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0)).alias(name))
        elif name in fill:
            exprs.append(F.coalesce(F.col(name), F.lit(0).cast(dtype)).alias(name))
        else:
            exprs.append(F.col(name))
    return df.select(*exprs)


def rowwise_mean(cols: list[str]) -> Column:
    """Mean across columns, skipping nulls (null when all are null)."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


# Fixed value: offset of the snapping grid.  Means of fixed-decimal data sit
# exactly on .5/.25/.125 (and 1/3) ties of a plain round, where two engines that
# sum in different orders disagree; moving the boundary to frac 0.46816... (no
# fraction with denominator below ~170 is within 4e-5 of it) makes them agree.
SNAP_OFFSET = 0.5318309886


def snap(c, digits: int) -> Column:
    """Value on a 10^-digits grid with the boundary off the exact ties.

    Used before ranking (so last-bit summation noise cannot reorder keys) and
    on outputs that are compared across engines.
    """
    col = F.col(c) if isinstance(c, str) else c
    scale = 10**digits
    # from 2^52 grid steps on a double has no digits left to snap (and floor() would leave its 64 bits)
    done = F.isnan(col) | (F.abs(col * scale) >= float(1 << 52))
    return F.when(done, col).otherwise(F.floor(col * scale + F.lit(SNAP_OFFSET)) / scale)
