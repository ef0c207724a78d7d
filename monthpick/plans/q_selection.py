"""Registered queries: scoring, selection, backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthpick.functions.columns import peak_type
from monthpick.operators.evaluation import (
    backtest_summary,
    matched_profit_by_month,
    net_profit_by_month,
    selection_except,
    selection_intersect,
    selections_per_month_describe,
)
from monthpick.operators.features import feature_matrix
from monthpick.operators.selection import (
    composite_score,
    normalized_signals,
    select_from_scores,
    select_opportunities,
)
from monthpick.plans.context import finish, inputs
from monthpick.plans.oracle_sql import ctes, month_str, rnd, rounded, snap_sql
from monthpick.plans.oracle_sql import peak_type as sql_peak_type
from monthpick.plans.pipelines import run, run_backtest
from monthpick.plans.registry import query
from monthpick.schema import DEFAULT_WEIGHTS
from monthpick.session import materialize
from monthpick.sources.adapters import driver_sources

# parameters of the registered selection queries
TOPK_FLOOR_THRESHOLD = 0.6  # about half of the months fall back to the floor of 10
CONDITIONAL_THRESHOLD = 0.5

_KEYS = list(DEFAULT_WEIGHTS)  # signal order of the score
_TOTAL = 0.0
for _k in _KEYS:
    _TOTAL += DEFAULT_WEIGHTS[_k]


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_SIG = {
    "sm_PSM_mean": "sm_PSM_mean",
    "sm_ACTIVATIONLEVEL_mean": "sm_ACTIVATIONLEVEL_mean",
    "hist_profit_rate": "hist_profit_rate_6m",
    "hist_mean_profit": "greatest(hist_mean_profit_6m, 0.0)",
    "scenario_agreement": "-sm_PSM_scenario_std",
}
def score_ctes(src: str = "matrix", sfx: str = "") -> list[tuple[str, str]]:
    """pool -> bounds -> normed -> scored CTEs over ``src`` (names get ``sfx``)."""
    pool = f"SELECT {src}.*, " + ", ".join(f"{e} AS s_{k}" for k, e in _SIG.items()) + f" FROM {src}"
    bounds = (
        "SELECT TARGET_MONTH, "
        + ", ".join(f"min(s_{k}) AS lo_{k}, max(s_{k}) AS hi_{k}" for k in _KEYS)
        + f" FROM pool{sfx} GROUP BY 1"
    )
    normed = (
        f"SELECT pool{sfx}.*, "
        + ", ".join(
            f"CASE WHEN hi_{k} = lo_{k} THEN 0.5 ELSE (s_{k} - lo_{k}) / (hi_{k} - lo_{k}) END AS norm_{k}"
            for k in _KEYS
        )
        + f" FROM pool{sfx} JOIN bounds{sfx} USING (TARGET_MONTH)"
    )
    expr = None
    for k in _KEYS:
        t = f"{_dbl(DEFAULT_WEIGHTS[k])} * norm_{k}"
        expr = t if expr is None else f"({expr} + {t})"
    scored = f"SELECT normed{sfx}.*, {snap_sql(f'{expr} / {_dbl(_TOTAL)}', 9)} AS score FROM normed{sfx}"
    return [(f"pool{sfx}", pool), (f"bounds{sfx}", bounds), (f"normed{sfx}", normed), (f"scored{sfx}", scored)]


def _ranked(k: int, t: float, floor: int = 10) -> str:
    return f"""SELECT r.* FROM (
  SELECT scored.*, row_number() OVER (PARTITION BY TARGET_MONTH ORDER BY score DESC NULLS LAST, EID, PEAKID) AS rank,
         sum(CASE WHEN score >= {_dbl(t)} THEN 1 ELSE 0 END) OVER (PARTITION BY TARGET_MONTH) AS n_pass
  FROM scored) r
WHERE CASE WHEN n_pass < {floor} THEN rank <= {floor} ELSE rank <= {k} AND score >= {_dbl(t)} END"""


SCORE_CTES = score_ctes()


def sel_ctes(k: int = 50, t: float = 0.0, extra=None):
    return ctes(
        "matrix",
        extra=[
            *SCORE_CTES,
            ("picked", _ranked(k, t)),
            ("sel", f"SELECT DISTINCT TARGET_MONTH, {sql_peak_type()} AS PEAK_TYPE, EID FROM picked"),
            *(extra or []),
        ],
    )


def _matrix(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    return feature_matrix(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features), i


NORM_COLS = [f"norm_{k}" for k in _KEYS]


@query(
    "minmax_normalize",
    ctes("matrix", extra=SCORE_CTES[:3])
    + "SELECT TARGET_MONTH, EID, PEAKID, "
    + rounded(NORM_COLS)
    + " FROM normed",
)
def q_minmax_normalize(spark, sf_dir):
    m, _ = _matrix(spark, sf_dir)
    return finish(normalized_signals(m).select("TARGET_MONTH", "EID", "PEAKID", *NORM_COLS))


@query(
    "composite_score",
    ctes("matrix", extra=SCORE_CTES) + "SELECT TARGET_MONTH, EID, PEAKID, score FROM scored",
)
def q_composite_score(spark, sf_dir):
    m, _ = _matrix(spark, sf_dir)
    return composite_score(m).select("TARGET_MONTH", "EID", "PEAKID", "score")


@query(
    "select_topk",
    sel_ctes(50, 0.0)
    + f"SELECT TARGET_MONTH, {sql_peak_type()} AS PEAK_TYPE, EID, score, CAST(rank AS INTEGER) AS rank FROM picked",
)
def q_select_topk(spark, sf_dir):
    m, _ = _matrix(spark, sf_dir)
    picked = select_opportunities(m, 50, keep_scores=True)
    return picked.select("TARGET_MONTH", peak_type().alias("PEAK_TYPE"), "EID", "score", "rank")


@query(
    "select_clamped_k",
    sel_ctes(100, 0.0)
    + " UNION ALL ".join(
        f"SELECT {asked} AS asked, TARGET_MONTH, {sql_peak_type()} AS PEAK_TYPE, EID, score, CAST(rank AS INTEGER) AS rank FROM picked WHERE rank <= {k}"
        for asked, k in ((3, 10), (25, 25), (500, 100))
    ),
)
def q_select_clamped_k(spark, sf_dir):
    """A wanted number of selections below 10, between and above 100."""
    m, _ = _matrix(spark, sf_dir)
    m = materialize(m, name="matrix")
    out = None
    for asked in (3, 25, 500):
        picked = select_opportunities(m, asked, keep_scores=True)
        picked = picked.select(F.lit(asked).alias("asked"), "TARGET_MONTH", peak_type().alias("PEAK_TYPE"), "EID", "score", "rank")
        out = picked if out is None else out.unionByName(picked)
    return out


@query(
    "select_topk_floor",
    sel_ctes(50, TOPK_FLOOR_THRESHOLD)
    + f"SELECT TARGET_MONTH, {sql_peak_type()} AS PEAK_TYPE, EID, score, CAST(rank AS INTEGER) AS rank FROM picked",
)
def q_select_topk_floor(spark, sf_dir):
    m, _ = _matrix(spark, sf_dir)
    picked = select_opportunities(m, 50, score_threshold=TOPK_FLOOR_THRESHOLD, keep_scores=True)
    return picked.select("TARGET_MONTH", peak_type().alias("PEAK_TYPE"), "EID", "score", "rank")


@query(
    "select_conditional_topk",
    sel_ctes(100, CONDITIONAL_THRESHOLD) + "SELECT * FROM sel",
)
def q_select_conditional_topk(spark, sf_dir):
    # model-path selection with the composite score standing in for a probability
    m, _ = _matrix(spark, sf_dir)
    scored = composite_score(m, score_col="proba")
    return select_from_scores(scored, CONDITIONAL_THRESHOLD)


@query("select_distinct", sel_ctes(50, 0.0) + "SELECT * FROM sel")
def q_select_distinct(spark, sf_dir):
    return run(driver_sources(spark, sf_dir))


@query(
    "selections_per_month_describe",
    sel_ctes(50, 0.0)
    + f"""SELECT count(n) AS count, {rnd('avg(n)', 6, 'mean')}, {rnd('stddev_samp(n)', 6, 'std')},
       {rnd('min(n)', 6, 'min')}, {rnd('quantile_cont(n, 0.25)', 6, 'p25')},
       {rnd('quantile_cont(n, 0.5)', 6, 'p50')}, {rnd('quantile_cont(n, 0.75)', 6, 'p75')},
       {rnd('max(n)', 6, 'max')}
FROM (SELECT TARGET_MONTH, CAST(count(*) AS DOUBLE) AS n FROM sel GROUP BY 1) c""",
)
def q_selections_per_month_describe(spark, sf_dir):
    return finish(selections_per_month_describe(run(driver_sources(spark, sf_dir))))


# ----------------------------------------------------------------- backtest

_TRUTH = f"""SELECT {month_str('MONTH')} AS TARGET_MONTH,
       {sql_peak_type()} AS PEAK_TYPE, EID, IS_PROFITABLE, PROFIT FROM hist"""
_BT = [
    ("truth_k", _TRUTH),
    ("months", "SELECT DISTINCT TARGET_MONTH FROM sel INTERSECT SELECT DISTINCT TARGET_MONTH FROM truth_k"),
    ("sel_m", "SELECT * FROM sel WHERE TARGET_MONTH IN (SELECT TARGET_MONTH FROM months)"),
    (
        "prof",
        "SELECT DISTINCT TARGET_MONTH, PEAK_TYPE, EID FROM truth_k "
        "WHERE IS_PROFITABLE AND TARGET_MONTH IN (SELECT TARGET_MONTH FROM months)",
    ),
    ("tp_rows", "SELECT * FROM sel_m INTERSECT SELECT * FROM prof"),
    ("fp_rows", "SELECT * FROM sel_m EXCEPT SELECT * FROM prof"),
    ("fn_rows", "SELECT * FROM prof EXCEPT SELECT * FROM sel_m"),
    (
        "np",
        "SELECT s.TARGET_MONTH, sum(coalesce(t.PROFIT, 0)) AS Net_Profit FROM sel_m s LEFT JOIN truth_k t "
        "ON s.TARGET_MONTH = t.TARGET_MONTH AND s.PEAK_TYPE = t.PEAK_TYPE AND s.EID = t.EID GROUP BY 1",
    ),
    (
        "conf",
        """SELECT m.TARGET_MONTH,
       (SELECT count(*) FROM sel_m x WHERE x.TARGET_MONTH = m.TARGET_MONTH) AS N_selected,
       (SELECT count(*) FROM tp_rows x WHERE x.TARGET_MONTH = m.TARGET_MONTH) AS TP,
       (SELECT count(*) FROM fp_rows x WHERE x.TARGET_MONTH = m.TARGET_MONTH) AS FP,
       (SELECT count(*) FROM fn_rows x WHERE x.TARGET_MONTH = m.TARGET_MONTH) AS FN
FROM months m""",
    ),
    (
        "pr",
        """SELECT conf.*, np.Net_Profit,
       CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS P,
       CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS R
FROM conf JOIN np USING (TARGET_MONTH)""",
    ),
    (
        "bt",
        """SELECT TARGET_MONTH AS MONTH, N_selected, TP, FP, FN, P AS Precision, R AS Recall,
       CASE WHEN P + R > 0 THEN 2 * P * R / (P + R) ELSE 0.0 END AS F1, Net_Profit FROM pr""",
    ),
]


def _bt_sql(body: str) -> str:
    return sel_ctes(50, 0.0, extra=_BT) + body


@query(
    "backtest_monthly",
    _bt_sql(
        "SELECT MONTH, N_selected, TP, FP, FN, "
        + ", ".join(rnd(c, 6, c) for c in ["Precision", "Recall", "F1"])
        + f", {rnd('Net_Profit', 4, 'Net_Profit')} FROM bt"
    ),
)
def q_backtest_monthly(spark, sf_dir):
    return finish(run_backtest(driver_sources(spark, sf_dir)).monthly)


@query(
    "backtest_summary",
    _bt_sql(
        f"""SELECT count(*) AS n_months, {rnd('avg(F1)', 6, 'mean_F1')}, {rnd('avg(Precision)', 6, 'mean_Precision')},
       {rnd('avg(Recall)', 6, 'mean_Recall')}, {rnd('sum(Net_Profit)', 4, 'total_Net_Profit')} FROM bt"""
    ),
)
def q_backtest_summary(spark, sf_dir):
    res = run_backtest(driver_sources(spark, sf_dir))
    s = backtest_summary(res.monthly)
    return finish(s)


@query(
    "net_profit",
    _bt_sql(f"SELECT TARGET_MONTH, {rnd('Net_Profit', 4, 'Net_Profit')}, N_selected FROM pr"),
)
def q_net_profit(spark, sf_dir):
    res = run_backtest(driver_sources(spark, sf_dir))
    return finish(net_profit_by_month(res.selections, res.hist))


@query(
    "semi_join_profit",
    _bt_sql(
        f"""SELECT TARGET_MONTH, count(*) AS n_matched, {rnd('sum(PROFIT)', 4, 'matched_profit')}
FROM truth_k t WHERE TARGET_MONTH IN (SELECT TARGET_MONTH FROM months)
  AND EXISTS (SELECT 1 FROM sel_m s WHERE s.TARGET_MONTH = t.TARGET_MONTH AND s.PEAK_TYPE = t.PEAK_TYPE AND s.EID = t.EID)
GROUP BY 1"""
    ),
)
def q_semi_join_profit(spark, sf_dir):
    res = run_backtest(driver_sources(spark, sf_dir))
    out = matched_profit_by_month(res.selections, res.hist)
    return finish(out)


@query("selection_intersect", _bt_sql("SELECT * FROM tp_rows"))
def q_selection_intersect(spark, sf_dir):
    res = run_backtest(driver_sources(spark, sf_dir))
    return selection_intersect(res.selections, res.hist)


@query(
    "selection_except",
    _bt_sql("SELECT *, 'FP' AS kind FROM fp_rows UNION ALL SELECT *, 'FN' AS kind FROM fn_rows"),
)
def q_selection_except(spark, sf_dir):
    res = run_backtest(driver_sources(spark, sf_dir))
    return selection_except(res.selections, res.hist)

