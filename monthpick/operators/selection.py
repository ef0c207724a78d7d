"""Scoring and per-month selection (10-100 keys per target month).

Rule-based path: each signal is min-max normalised over the month's candidate
pool (ON and OFF together), combined with weights renormalised by the weights
actually used, then the top K per month are kept (with a floor of 10 taken
from the unfiltered pool when fewer than 10 pass the score threshold).
Model path: the same top-K shape over a probability column.

Scale notes
-----------
* Per-month min/max come from a ``groupBy(TARGET_MONTH)`` (partial aggregation,
  one row per month) broadcast back — never a window that would pull a whole
  month into one task.  The broadcast side has one row per target month.
* Top-K uses ``row_number() <= limit`` with a literal limit directly above the
  window, so Catalyst plans a partial ``WindowGroupLimit`` before the shuffle:
  each map task forwards at most ``limit`` rows per month.
* Rows passing a ``>=`` threshold are a prefix of the descending order, so one
  ranking serves both branches and the pass count is read from the (at most
  ``limit``) ranked survivors of each month.
* Ties are broken by (EID, PEAKID) ascending; scores are snapped to 1e-9
  before ranking so last-bit summation noise cannot reorder keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthpick.functions.columns import peak_type, rowwise_mean, snap
from monthpick.schema import DEFAULT_TARGET_K, DEFAULT_WEIGHTS, MAX_K, MIN_K, hist_feature_names, lookbacks

SCORE_DIGITS = 9


def clamp_k(target_k: int) -> int:
    return max(MIN_K, min(MAX_K, int(target_k)))


def score_signals(columns: list[str]) -> list[tuple[str, Column]]:
    """(weight key, raw signal) for every signal the pool provides, in order."""
    by_key = {  # weight key -> (source columns, signal over them)
        "sm_PSM_mean": (["sm_PSM_mean"], rowwise_mean),
        "sm_ACTIVATIONLEVEL_mean": (["sm_ACTIVATIONLEVEL_mean"], rowwise_mean),
        "hist_profit_rate": (_history(columns, "hist_profit_rate"), rowwise_mean),
        # losses count as no profit at all
        "hist_mean_profit": (_history(columns, "hist_mean_profit"), lambda cols: F.greatest(rowwise_mean(cols), F.lit(0.0))),
        "scenario_agreement": (["sm_PSM_scenario_std"], lambda cols: -F.col(cols[0])),
    }
    return [(key, signal(cols)) for key, (cols, signal) in by_key.items() if cols and set(cols) <= set(columns)]


def _history(columns: list[str], stem: str) -> list[str]:
    """The history columns of every lookback that the pool has."""
    return [c for n in lookbacks(columns) for c in hist_feature_names(n) if c.startswith(stem) and c in columns]


def minmax_normalize(df: DataFrame, cols: list[str], group: str = "TARGET_MONTH") -> DataFrame:
    """Scale ``cols`` to [0, 1] within each ``group``; a constant column -> 0.5."""
    bounds = df.groupBy(group).agg(
        *[F.min(c).alias(f"__lo_{c}") for c in cols], *[F.max(c).alias(f"__hi_{c}") for c in cols]
    )
    # one row per target month: bounded by the calendar; any other group is the optimizer's to size
    j = df.join(F.broadcast(bounds) if group == "TARGET_MONTH" else bounds, group)
    out = [F.col(c) for c in df.columns if c not in cols]
    for c in cols:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out.append(F.when(hi == lo, F.lit(0.5)).otherwise((F.col(c) - lo) / (hi - lo)).alias(c))
    return j.select(*out)


def normalized_signals(matrix: DataFrame) -> DataFrame:
    """Matrix columns plus ``norm_<signal>`` in [0, 1] for every signal present."""
    signals = score_signals(matrix.columns)
    names = [f"norm_{key}" for key, _ in signals]
    pool = matrix.select("*", *[expr.alias(n) for n, (_, expr) in zip(names, signals)])
    return minmax_normalize(pool, names).select(*matrix.columns, *names)


def composite_score(
    matrix: DataFrame,
    weights: dict | None = None,
    score_col: str = "score",
    digits: int | None = SCORE_DIGITS,
) -> DataFrame:
    """Append the weighted composite score (in [0, 1]) to the candidate pool.

    Terms are added in signal order and divided by the sum of the weights of
    the signals actually present (absent signals contribute nothing).
    """
    weights = DEFAULT_WEIGHTS if weights is None else weights
    keys = [key for key, _ in score_signals(matrix.columns)]
    normed = normalized_signals(matrix)
    score = None
    total = 0.0
    for key in keys:
        term = F.lit(float(weights.get(key, 0))) * F.col(f"norm_{key}")
        score = term if score is None else score + term
        total += weights.get(key, 0)
    if score is None:
        score = F.lit(0.0)
    if total > 0:
        score = score / F.lit(total)
    if digits is not None:
        score = snap(score, digits)
    return normed.select(*matrix.columns, score.alias(score_col))


def topk_with_floor(
    scored: DataFrame,
    score_col: str,
    threshold,
    k: int,
    floor: int = MIN_K,
    group: str = "TARGET_MONTH",
    order_keys: tuple[str, ...] = ("EID", "PEAKID"),
) -> DataFrame:
    """Per group: if at least ``floor`` rows have score >= threshold keep the
    best ``k`` of them, else keep the best ``floor`` rows of the whole pool.
    ``threshold`` is a number or a per-row Column (e.g. a per-fold threshold).

    Only the top ``max(k, floor)`` rows per group survive the ranking
    (``WindowGroupLimit``).  Passing rows are a prefix of that order, so the
    count of passing rows among the survivors is min(n_pass, limit), and
    "n_pass < floor" can be read from the survivors alone: the pool is scanned
    once and the second window runs on at most ``limit`` rows per group.
    """
    # NaN sorts above every number in Spark: a missing score ranks last and fails the threshold
    score = F.nanvl(F.col(score_col).cast("double"), F.lit(None).cast("double"))
    w = Window.partitionBy(group).orderBy(score.desc_nulls_last(), *order_keys)
    limit = max(k, floor)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    passing = F.coalesce(score >= thr, F.lit(False))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    ranked = ranked.withColumn(
        "__n_pass",
        F.sum(passing.cast("int")).over(Window.partitionBy(group)),
    )
    keep = F.when(F.col("__n_pass") < floor, F.col("rank") <= floor).otherwise(
        (F.col("rank") <= k) & passing
    )
    return ranked.where(keep).drop("__n_pass")


def as_opportunities(selected: DataFrame) -> DataFrame:
    """Output format: distinct (TARGET_MONTH, PEAK_TYPE, EID)."""
    return selected.select(
        "TARGET_MONTH", peak_type("PEAKID").alias("PEAK_TYPE"), "EID"
    ).dropDuplicates()


def select_opportunities(
    matrix: DataFrame,
    target_k: int = DEFAULT_TARGET_K,
    weights: dict | None = None,
    score_threshold: float = 0.0,
    keep_scores: bool = False,
) -> DataFrame:
    """Rule-based selection for every target month of the matrix."""
    k = clamp_k(target_k)
    scored = composite_score(matrix, weights)
    picked = topk_with_floor(scored, "score", score_threshold, k, MIN_K)
    if keep_scores:
        return picked
    return as_opportunities(picked)


def select_from_scores(
    scored: DataFrame,
    threshold: float,
    proba_col: str = "proba",
    target_k: int | None = None,
) -> DataFrame:
    """Model selection: >= 10 rows at or above ``threshold`` -> the first 100 of
    them; otherwise the top 10 overall.  ``target_k`` is accepted and ignored,
    as in the reference."""
    del target_k
    picked = topk_with_floor(scored, proba_col, threshold, MAX_K, MIN_K)
    return as_opportunities(picked)
