"""DuckDB oracles: the same questions asked in plain ANSI SQL.

The oracles are written as straightforward SQL (plain ``avg`` per group, an
inequality join + ``row_number`` for the history window, brute-force pair
counts for ROC-AUC) rather than mirroring the Spark plans, so they check the
semantics, not the implementation.  All CTEs start from the driver's
``lineitem`` and ``orders`` views through the adapter expressions of
FIXTURES.md §2.
"""

from __future__ import annotations

from monthpick.functions.columns import SNAP_OFFSET
from monthpick.schema import SIM_SIGNALS, matrix_feature_names

EID = "concat('EID_', lpad(cast(l_suppkey AS VARCHAR), 4, '0'))"
PEAKID = "CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER)"


def month_of(ts: str) -> str:
    return f"CAST(year({ts}) * 100 + month({ts}) AS INTEGER)"


def next_month(m: str) -> str:
    return f"CAST(CASE WHEN {m} % 100 = 12 THEN {m} + 89 ELSE {m} + 1 END AS INTEGER)"


def prev_month(m: str) -> str:
    return f"CAST(CASE WHEN {m} % 100 = 1 THEN {m} - 89 ELSE {m} - 1 END AS INTEGER)"


def month_str(m: str) -> str:
    return f"(substr(CAST({m} AS VARCHAR), 1, 4) || '-' || substr(CAST({m} AS VARCHAR), 5, 2))"


def peak_type(c: str = "PEAKID") -> str:
    return f"CASE WHEN {c} = 0 THEN 'OFF' WHEN {c} = 1 THEN 'ON' END"


def _sim(price_col: str, shifted: bool) -> str:
    ts = "(l_shipdate + INTERVAL 1 MONTH)" if shifted else "l_shipdate"
    return f"""SELECT CAST(CAST(l_linenumber % 3 + 1 AS INTEGER) AS VARCHAR) AS SCENARIOID,
       {EID} AS EID, {ts} AS DATETIME, {PEAKID} AS PEAKID,
       l_quantity AS ACTIVATIONLEVEL, l_discount AS WINDIMPACT, l_tax AS SOLARIMPACT,
       l_discount - l_tax AS HYDROIMPACT, l_quantity * l_discount AS NONRENEWBALIMPACT,
       l_quantity * l_tax AS EXTERNALIMPACT, CAST(l_linenumber AS DOUBLE) AS LOADIMPACT,
       -l_discount AS TRANSMISSIONOUTAGEIMPACT,
       l_extendedprice * (1 - l_discount) AS {price_col},
       {month_of(ts)} AS MONTH
FROM lineitem"""


def _sim_feats(name: str, src: str, price_col: str, prefix: str, key_expr: str, where: str = "TRUE") -> str:
    means = ", ".join(f"avg({c}) AS {prefix}_{c}_mean" for c in [*SIM_SIGNALS, price_col])
    return f"""{name}_mean AS (
  SELECT {key_expr} AS TARGET, EID, PEAKID, {means}
  FROM {src} WHERE EID IS NOT NULL AND PEAKID IS NOT NULL AND {where}
  GROUP BY 1, 2, 3),
{name}_scen AS (
  SELECT TARGET, EID, PEAKID, stddev_pop(m) AS {prefix}_{price_col}_scenario_std
  FROM (SELECT {key_expr} AS TARGET, EID, PEAKID, SCENARIOID, avg({price_col}) AS m
        FROM {src} WHERE EID IS NOT NULL AND PEAKID IS NOT NULL AND SCENARIOID IS NOT NULL AND {where}
        GROUP BY 1, 2, 3, 4) s
  GROUP BY 1, 2, 3),
{name} AS (
  SELECT a.*, b.{prefix}_{price_col}_scenario_std
  FROM {name}_mean a LEFT JOIN {name}_scen b USING (TARGET, EID, PEAKID))"""


def _fill(cols):
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in cols)


_FEATURES = matrix_feature_names(6)

# name -> CTE body; ``ctes(...)`` pulls in dependencies in order
CTE = {
    "prices": f"""SELECT {EID} AS EID, l_shipdate AS DATETIME, {PEAKID} AS PEAKID,
       l_extendedprice * (1 - l_discount) AS PRICEREALIZED, {month_of('l_shipdate')} AS MONTH
FROM lineitem""",
    "costs_raw": f"""SELECT {EID} AS EID, strftime(o_orderdate, '%Y-%m') AS MONTH, {PEAKID} AS PEAKID,
       4 * sum(l_extendedprice) AS C
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "costs": """SELECT EID, CAST(replace(MONTH, '-', '') AS INTEGER) AS MONTH, PEAKID, C FROM costs_raw""",
    "monthly_pr": """SELECT EID, MONTH, PEAKID, coalesce(sum(PRICEREALIZED), 0) AS PR
FROM prices WHERE EID IS NOT NULL AND MONTH IS NOT NULL AND PEAKID IS NOT NULL GROUP BY 1, 2, 3""",
    "hist": """SELECT coalesce(p.EID, c.EID) AS EID, coalesce(p.MONTH, c.MONTH) AS MONTH,
       coalesce(p.PEAKID, c.PEAKID) AS PEAKID, coalesce(p.PR, 0) AS PR, coalesce(c.C, 0) AS C,
       coalesce(p.PR, 0) - coalesce(c.C, 0) AS PROFIT,
       (coalesce(p.PR, 0) - coalesce(c.C, 0)) > 0 AS IS_PROFITABLE
FROM monthly_pr p FULL OUTER JOIN costs c
  ON p.EID = c.EID AND p.MONTH = c.MONTH AND p.PEAKID = c.PEAKID""",
    "sim_monthly": _sim("PSM", True),
    "sim_daily": _sim("PSD", False),
}
DEPS = {
    "costs": ["costs_raw"],
    "monthly_pr": ["prices"],
    "hist": ["monthly_pr", "costs"],
    "sm": ["sim_monthly"],
    "sd": ["sim_daily"],
    "targets": ["sm"],
    "month_map": ["hist", "targets"],
    "histf": ["month_map"],
    "matrix": ["sm", "sd", "histf"],
    "truth": ["hist"],
    "labeled": ["matrix", "truth"],
}

# multi-CTE blocks (already "name AS (...)" formatted)
BLOCK = {
    "sm": _sim_feats("sm", "sim_monthly", "PSM", "sm", "MONTH"),
    "sd": _sim_feats(
        "sd",
        "sim_daily",
        "PSD",
        "sd",
        next_month("MONTH"),
        "DATETIME <= date_trunc('month', DATETIME) + INTERVAL 7 DAY",
    ),
}
CTE["targets"] = "SELECT DISTINCT TARGET FROM sm"
CTE["month_map"] = f"""SELECT TARGET, MONTH FROM (
  SELECT t.TARGET, p.MONTH, row_number() OVER (PARTITION BY t.TARGET ORDER BY p.MONTH DESC) AS rk
  FROM targets t JOIN (SELECT DISTINCT MONTH FROM hist WHERE MONTH IS NOT NULL) p
    ON p.MONTH <= {prev_month('t.TARGET')}) x
WHERE rk <= 6"""
CTE["histf"] = """SELECT m.TARGET, h.EID, h.PEAKID,
       avg(CAST(h.IS_PROFITABLE AS INTEGER)) AS hist_profit_rate_6m,
       avg(h.PROFIT) AS hist_mean_profit_6m, avg(h.PR) AS hist_mean_pr_6m,
       avg(h.C) AS hist_mean_c_6m, count(h.MONTH) AS hist_months_active_6m
FROM hist h JOIN month_map m ON h.MONTH = m.MONTH
WHERE h.EID IS NOT NULL AND h.PEAKID IS NOT NULL
GROUP BY 1, 2, 3"""
CTE["matrix"] = f"""SELECT sm.EID, sm.PEAKID, {_fill(_FEATURES)}, sm.TARGET,
       {month_str('sm.TARGET')} AS TARGET_MONTH
FROM sm LEFT JOIN sd USING (TARGET, EID, PEAKID) LEFT JOIN histf USING (TARGET, EID, PEAKID)"""
CTE["truth"] = "SELECT MONTH AS TARGET, EID, PEAKID, IS_PROFITABLE, PROFIT FROM hist"
CTE["labeled"] = f"""SELECT m.*, CAST(coalesce(CAST(t.IS_PROFITABLE AS INTEGER), 0) AS INTEGER) AS IS_PROFITABLE_L,
       coalesce(t.PROFIT, 0) AS PROFIT_L
FROM matrix m LEFT JOIN truth t ON m.TARGET = t.TARGET AND m.EID = t.EID AND m.PEAKID = t.PEAKID"""


def lookback_ctes(n: int) -> list[tuple[str, str]]:
    """month_map{n} / histf{n} / matrix{n}: the history window with lookback n."""
    feats = matrix_feature_names(n)
    mm = CTE["month_map"].replace("WHERE rk <= 6", f"WHERE rk <= {n}")
    hf = CTE["histf"].replace("_6m", f"_{n}m").replace("JOIN month_map m", f"JOIN month_map{n} m")
    mx = f"""SELECT sm.EID, sm.PEAKID, {_fill(feats)}, sm.TARGET,
       {month_str('sm.TARGET')} AS TARGET_MONTH
FROM sm LEFT JOIN sd USING (TARGET, EID, PEAKID) LEFT JOIN histf{n} USING (TARGET, EID, PEAKID)"""
    return [(f"month_map{n}", mm), (f"histf{n}", hf), (f"matrix{n}", mx)]


def ctes(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause containing ``names`` and their dependencies, in order."""
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [BLOCK[n] if n in BLOCK else f"{n} AS (\n{CTE[n]})" for n in order]
    for name, body in extra or []:
        parts.append(f"{name} AS (\n{body})")
    return "WITH " + ",\n".join(parts) + "\n"


def snap_sql(expr: str, digits: int) -> str:
    """``expr`` on a 10^-digits grid (DuckDB form of ``context.snap``)."""
    scale = 10**digits
    return f"(floor(({expr}) * {scale} + {SNAP_OFFSET}) / {scale})"


def rnd(expr: str, digits: int, alias: str) -> str:
    return f"{snap_sql(expr, digits)} AS {alias}"


WIDE = {"PR", "C", "PROFIT", "Net_Profit", "total_Net_Profit", "matched_profit", "net_profit"}  # large magnitudes: 4 dp (the data's own grid)


def digits_for(col: str) -> int:
    if col in WIDE or "PSM" in col or "PSD" in col or "PRICEREALIZED" in col:
        return 4
    if col.startswith("hist_mean_"):
        return 4
    return 6


INTEGER_COLS = ("hist_months_active_",)  # counts stay integers


def rounded(cols, source_alias: str = "") -> str:
    pre = f"{source_alias}." if source_alias else ""
    return ", ".join(
        f"{pre}{c}" if c.startswith(INTEGER_COLS) else rnd(f"{pre}{c}", digits_for(c), c) for c in cols
    )

