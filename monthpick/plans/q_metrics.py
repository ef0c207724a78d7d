"""Registered queries: folds, classifier metrics, diagnostics.

The scored table is the labeled dataset with the composite score standing in
for a model probability (fold = target month), so every metric stays checked
against SQL without training a model.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from monthpick.operators.dataset import fill_missing_features, labeled_dataset
from monthpick.operators.diagnostics import correlation_pairs, variance_screen
from monthpick.operators.features import feature_matrix
from monthpick.operators.folds import fold_eligibility, fold_map, pos_weight
from monthpick.operators.metrics import (
    average_precision,
    best_threshold,
    classification_report,
    evaluation_rows,
    expanding_mean,
    fold_rollup,
    roc_auc,
    threshold_sweep,
)
from monthpick.operators.selection import composite_score
from monthpick.plans.context import finish, inputs
from monthpick.plans.oracle_sql import ctes, digits_for, lookback_ctes, rnd
from monthpick.plans.q_selection import score_ctes
from monthpick.plans.registry import query
from monthpick.schema import MODEL_FEATURES, available_features, matrix_feature_names, sweep_thresholds
from monthpick.session import materialize

# ------------------------------------------------------------------ inputs


def labeled(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    return materialize(labeled_dataset(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features))


def scored_folds(spark, sf_dir):
    sc = composite_score(labeled(spark, sf_dir))
    return materialize(
        sc.select(
            F.col("TARGET_MONTH").alias("fold"),
            "EID",
            "PEAKID",
            F.col("score").alias("proba"),
            F.col("IS_PROFITABLE").alias("label"),
        )
    )


_TH = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in sweep_thresholds())
_BASE = [
    *score_ctes("labeled", "_l"),
    ("sf", "SELECT TARGET_MONTH AS fold, EID, PEAKID, score AS proba, IS_PROFITABLE_L AS label FROM scored_l"),
    ("th", f"SELECT * FROM (VALUES {_TH}) t(threshold)"),
    (
        "sweep_c",
        """SELECT f.fold, th.threshold,
       CAST(sum(CASE WHEN proba >= threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
       CAST(sum(CASE WHEN proba >= threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
       CAST(sum(CASE WHEN proba < threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FN,
       CAST(sum(label) AS BIGINT) AS n_pos, count(*) AS n
FROM sf f CROSS JOIN th GROUP BY 1, 2""",
    ),
    (
        "sweep_p",
        """SELECT *, CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS precision,
       CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS recall FROM sweep_c""",
    ),
    (
        "sweep",
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) "
        "ELSE 0.0 END AS f1 FROM sweep_p",
    ),
    (
        "best",
        """SELECT fold, CASE WHEN mx > 0 THEN tmin ELSE 0.5 END AS threshold,
       CASE WHEN mx > 0 THEN mx ELSE 0.0 END AS score
FROM (SELECT s.fold, m.mx, min(s.threshold) FILTER (WHERE s.f1 = m.mx) AS tmin
      FROM sweep s JOIN (SELECT fold, max(f1) AS mx FROM sweep GROUP BY 1) m USING (fold)
      GROUP BY 1, 2) x""",
    ),
    (
        "cnt",
        """SELECT sf.fold, b.threshold,
       CAST(sum(CASE WHEN proba >= b.threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
       CAST(sum(CASE WHEN proba >= b.threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
       CAST(sum(CASE WHEN proba < b.threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FN,
       CAST(sum(CASE WHEN proba < b.threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN
FROM sf JOIN best b USING (fold) GROUP BY 1, 2""",
    ),
    (
        "pn",
        "SELECT fold, CAST(sum(label) AS BIGINT) AS P, CAST(sum(1 - label) AS BIGINT) AS N FROM sf GROUP BY 1",
    ),
    (
        "auc",
        """SELECT pn.fold, CASE WHEN P > 0 AND N > 0 THEN coalesce(u.u, 0) / (P * N) ELSE 0.0 END AS roc_auc
FROM pn LEFT JOIN (
  SELECT a.fold, sum(CASE WHEN a.proba > b.proba THEN 1.0 WHEN a.proba = b.proba THEN 0.5 ELSE 0.0 END) AS u
  FROM sf a JOIN sf b ON a.fold = b.fold AND a.label = 1 AND b.label = 0 GROUP BY 1) u USING (fold)""",
    ),
    (
        "ap",
        """SELECT pn.fold, CASE WHEN P > 0 AND N > 0 THEN coalesce(a.s, 0) / P ELSE 0.0 END AS pr_auc
FROM pn LEFT JOIN (
  SELECT fold, sum(pos_s * (tp / n)) AS s FROM (
    SELECT d.fold, d.s, d.pos_s, sum(x.label) AS tp, count(*) AS n
    FROM (SELECT fold, proba AS s, sum(label) AS pos_s FROM sf GROUP BY 1, 2 HAVING sum(label) > 0) d
    JOIN sf x ON x.fold = d.fold AND x.proba >= d.s GROUP BY 1, 2, 3) y GROUP BY 1) a USING (fold)""",
    ),
    (
        "ev_p",
        """SELECT fold AS label, threshold, CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS precision,
       CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS recall,
       TP + FP AS n_positive_pred, TP + FN AS n_positive_true FROM cnt""",
    ),
    (
        "ev",
        """SELECT ev_p.*, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
       ELSE 0.0 END AS f1, auc.roc_auc, ap.pr_auc
FROM ev_p JOIN auc ON ev_p.label = auc.fold JOIN ap ON ev_p.label = ap.fold""",
    ),
]


def metric_sql(body: str) -> str:
    return ctes("labeled", extra=_BASE) + body


def _r(cols):
    return ", ".join(rnd(c, 6, c) for c in cols)


@query(
    "threshold_sweep",
    metric_sql(f"SELECT fold, TP, FP, FN, n_pos, n, {_r(['threshold', 'precision', 'recall', 'f1'])} FROM sweep"),
)
def q_threshold_sweep(spark, sf_dir):
    return finish(threshold_sweep(scored_folds(spark, sf_dir)))


@query("best_threshold", metric_sql(f"SELECT fold, {_r(['threshold', 'score'])} FROM best"))
def q_best_threshold(spark, sf_dir):
    return finish(best_threshold(threshold_sweep(scored_folds(spark, sf_dir))))


@query("roc_auc", metric_sql(f"SELECT fold, {_r(['roc_auc'])} FROM auc"))
def q_roc_auc(spark, sf_dir):
    return finish(roc_auc(scored_folds(spark, sf_dir)))


@query("average_precision", metric_sql(f"SELECT fold, {_r(['pr_auc'])} FROM ap"))
def q_average_precision(spark, sf_dir):
    return finish(average_precision(scored_folds(spark, sf_dir)))


_REPORT = """SELECT fold, p0, r0, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0, s0,
       p1, r1, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1, s1, acc
FROM (SELECT fold,
        CASE WHEN TN + FN > 0 THEN TN / (TN + FN) ELSE 0.0 END AS p0,
        CASE WHEN TN + FP > 0 THEN TN / (TN + FP) ELSE 0.0 END AS r0, CAST(TN + FP AS DOUBLE) AS s0,
        CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS p1,
        CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS r1, CAST(TP + FN AS DOUBLE) AS s1,
        (TP + TN) / (TP + TN + FP + FN) AS acc FROM cnt) c"""


@query(
    "classification_report",
    ctes(
        "labeled",
        extra=[*_BASE, ("rep", _REPORT)],
    )
    + f"""SELECT fold, '0' AS class, {rnd('p0', 6, 'precision')}, {rnd('r0', 6, 'recall')}, {rnd('f0', 6, 'f1_score')}, {rnd('s0', 6, 'support')} FROM rep
UNION ALL SELECT fold, '1', {rnd('p1', 6, 'precision')}, {rnd('r1', 6, 'recall')}, {rnd('f1', 6, 'f1_score')}, {rnd('s1', 6, 'support')} FROM rep
UNION ALL SELECT fold, 'accuracy', NULL, NULL, {rnd('acc', 6, 'f1_score')}, {rnd('s0 + s1', 6, 'support')} FROM rep
UNION ALL SELECT fold, 'macro avg', {rnd('(p0 + p1) / 2', 6, 'precision')}, {rnd('(r0 + r1) / 2', 6, 'recall')},
       {rnd('(f0 + f1) / 2', 6, 'f1_score')}, {rnd('s0 + s1', 6, 'support')} FROM rep
UNION ALL SELECT fold, 'weighted avg',
       {rnd('CASE WHEN s0 + s1 > 0 THEN (p0 * s0 + p1 * s1) / (s0 + s1) ELSE 0.0 END', 6, 'precision')},
       {rnd('CASE WHEN s0 + s1 > 0 THEN (r0 * s0 + r1 * s1) / (s0 + s1) ELSE 0.0 END', 6, 'recall')},
       {rnd('CASE WHEN s0 + s1 > 0 THEN (f0 * s0 + f1 * s1) / (s0 + s1) ELSE 0.0 END', 6, 'f1_score')},
       {rnd('s0 + s1', 6, 'support')} FROM rep""",
)
def q_classification_report(spark, sf_dir):
    sf = scored_folds(spark, sf_dir)
    return finish(classification_report(sf, best_threshold(threshold_sweep(sf))))


_EV = ["threshold", "f1", "precision", "recall", "roc_auc", "pr_auc"]


@query(
    "evaluation_rows",
    metric_sql(f"SELECT label, {_r(_EV)}, n_positive_pred, n_positive_true FROM ev"),
)
def q_evaluation_rows(spark, sf_dir):
    return finish(evaluation_rows(scored_folds(spark, sf_dir)))


def _prev_fold_ctes():
    """Same chain as _BASE, evaluated at the previous fold's tuned threshold."""
    body = dict(_BASE)
    prev = [
        ("best_prev", "SELECT fold, coalesce(lag(threshold) OVER (ORDER BY fold), 0.3) AS threshold FROM best"),
        ("cnt_prev", body["cnt"].replace("JOIN best b USING (fold)", "JOIN best_prev b USING (fold)")),
        ("ev_p_prev", body["ev_p"].replace("FROM cnt", "FROM cnt_prev")),
        ("ev_prev", body["ev"].replace("ev_p", "ev_p_prev")),
    ]
    return ctes("labeled", extra=[*_BASE, *prev])


@query(
    "evaluation_rows_prev_fold",
    _prev_fold_ctes() + f"SELECT label, {_r(_EV)}, n_positive_pred, n_positive_true FROM ev_prev",
)
def q_evaluation_rows_prev_fold(spark, sf_dir):
    return finish(evaluation_rows(scored_folds(spark, sf_dir), tune_on="previous_fold"))


@query(
    "expanding_metric",
    metric_sql(
        "SELECT label, "
        + rnd("avg(f1) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 6, "avg_f1")
        + ", "
        + rnd("avg(pr_auc) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 6, "avg_pr_auc")
        + " FROM ev"
    ),
)
def q_expanding_metric(spark, sf_dir):
    return finish(expanding_mean(evaluation_rows(scored_folds(spark, sf_dir))))


@query(
    "fold_rollup",
    metric_sql(
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, {rnd(f'avg({m})', 6, 'mean')}, {rnd(f'stddev_samp({m})', 6, 'std')}, "
            f"{rnd(f'min({m})', 6, 'min')}, {rnd(f'max({m})', 6, 'max')} FROM ev"
            for m in ["f1", "precision", "recall", "pr_auc"]
        )
    ),
)
def q_fold_rollup(spark, sf_dir):
    return finish(fold_rollup(evaluation_rows(scored_folds(spark, sf_dir))))


# ------------------------------------------------------------------- folds

_CAL = [
    (
        "cal",
        f"""SELECT TARGET_MONTH, CAST(row_number() OVER (ORDER BY TARGET_MONTH) - 1 AS INTEGER) AS i FROM (
  SELECT strftime(d, '%Y-%m') AS TARGET_MONTH FROM (
    SELECT unnest(generate_series(min(strptime(TARGET_MONTH || '-01', '%Y-%m-%d')),
                                  max(strptime(TARGET_MONTH || '-01', '%Y-%m-%d')), INTERVAL 1 MONTH)) AS d
    FROM labeled) g) c""",
    ),
    (
        "mstat",
        """SELECT c.TARGET_MONTH, c.i, coalesce(s.rows, 0) AS rows, coalesce(s.pos, 0) AS pos,
       coalesce(s.classes, 0) AS classes
FROM cal c LEFT JOIN (SELECT TARGET_MONTH, count(*) AS rows, CAST(sum(IS_PROFITABLE_L) AS BIGINT) AS pos,
                             count(DISTINCT IS_PROFITABLE_L) AS classes FROM labeled GROUP BY 1) s USING (TARGET_MONTH)""",
    ),
    (
        "elig",
        """SELECT i - 6 + 1 AS fold_id, TARGET_MONTH AS VAL_MONTH,
       first_value(TARGET_MONTH) OVER (ORDER BY i) AS TRAIN_FIRST,
       lag(TARGET_MONTH) OVER (ORDER BY i) AS TRAIN_LAST, i AS n_train_months,
       coalesce(sum(rows) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_train_rows,
       coalesce(sum(pos) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_train_pos,
       rows AS n_val_rows, pos AS n_val_pos, classes AS n_val_classes
FROM mstat""",
    ),
]


def fold_sql(body: str) -> str:
    return ctes("labeled", extra=_CAL) + body


@query(
    "fold_map",
    fold_sql("SELECT fold_id, VAL_MONTH, TRAIN_FIRST, TRAIN_LAST, n_train_months FROM elig WHERE n_train_months >= 6"),
)
def q_fold_map(spark, sf_dir):
    return fold_map(labeled(spark, sf_dir))


@query(
    "fold_eligibility",
    fold_sql(
        """SELECT fold_id, VAL_MONTH, TRAIN_FIRST, TRAIN_LAST, n_train_months,
       CAST(n_train_rows AS BIGINT) AS n_train_rows, CAST(n_train_pos AS BIGINT) AS n_train_pos,
       n_val_rows, n_val_pos, n_val_classes,
       (n_train_rows > 0 AND n_train_pos >= 5 AND n_val_rows > 0 AND n_val_classes >= 2) AS eligible
FROM elig WHERE n_train_months >= 6"""
    ),
)
def q_fold_eligibility(spark, sf_dir):
    return fold_eligibility(labeled(spark, sf_dir))


@query(
    "pos_weight",
    fold_sql(
        "SELECT fold_id, VAL_MONTH, "
        + rnd("CASE WHEN n_train_pos > 0 THEN (n_train_rows - n_train_pos) / n_train_pos ELSE 1.0 END", 6, "pos_weight")
        + " FROM elig WHERE n_train_months >= 6"
    ),
)
def q_pos_weight(spark, sf_dir):
    return finish(pos_weight(fold_eligibility(labeled(spark, sf_dir))))


# ------------------------------------------------------------- diagnostics

_FEATS = available_features(["EID", "PEAKID", *matrix_feature_names(6), "TARGET_MONTH"])
_PAIRS = list(combinations(_FEATS, 2))


@query(
    "variance_screen",
    ctes("matrix")
    + "SELECT feature FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp(CAST({c} AS DOUBLE)) AS v FROM matrix" for c in _FEATS)
    + " UNION ALL SELECT 'ALWAYS_ONE', var_samp(1.0) FROM matrix) x WHERE v = 0",
)
def q_variance_screen(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    m = feature_matrix(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features)
    return variance_screen(m.withColumn("ALWAYS_ONE", F.lit(1.0)), [*available_features(m.columns), "ALWAYS_ONE"])


@query(
    "correlation_pairs",
    ctes(
        "matrix",
        extra=[
            (
                "cw",
                "SELECT "
                + ", ".join(
                    f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c{i}" for i, (a, b) in enumerate(_PAIRS)
                )
                + " FROM matrix",
            ),
            (
                "cl",
                " UNION ALL ".join(
                    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, c{i} AS c FROM cw" for i, (a, b) in enumerate(_PAIRS)
                ),
            ),
        ],
    )
    + f"SELECT feature_a, feature_b, {rnd('abs(c)', 6, 'abs_corr')} FROM cl "
    "WHERE c IS NOT NULL AND NOT isnan(c) AND abs(c) > 0.95",
)
def q_correlation_pairs(spark, sf_dir):
    i = inputs(spark, sf_dir).stage_all()
    m = feature_matrix(i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features)
    return finish(correlation_pairs(m, available_features(m.columns)))


@query(
    "fill_missing_features",
    ctes("sm", "sd", "hist", "targets", extra=lookback_ctes(3))
    + "SELECT EID, TARGET_MONTH, "
    + ", ".join(
        rnd(f"CAST({c} AS DOUBLE)" if c in matrix_feature_names(3) or c == "PEAKID" else "0.0", digits_for(c), c)
        for c in MODEL_FEATURES
    )
    + " FROM matrix3",
)
def q_fill_missing_features(spark, sf_dir):
    # a lookback-3 matrix lacks the model's *_6m history columns -> 0.0
    i = inputs(spark, sf_dir).stage_all()
    m = feature_matrix(i.sim_monthly, i.sim_daily, i.hist, lookback=3, sm_features=i.sm_features, sd_features=i.sd_features)
    return finish(fill_missing_features(m, MODEL_FEATURES, keep=["EID", "TARGET_MONTH"]))

