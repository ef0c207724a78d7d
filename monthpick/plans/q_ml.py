"""Registered queries that train models: walk-forward, comparison, SMOTE,
rescoring (M1-M7, C11-C13, S13).

Every query goes over all eligible folds of the whole labeled dataset and every
fold trains on its full history, boosted trees with all rounds of the library.
What SQL can say about them (the folds with their rows, positives and scalers,
the class counts after SMOTE) has an oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from monthpick.functions.columns import snap
from monthpick.operators.dataset import labeled_dataset
from monthpick.operators.folds import fold_eligibility
from monthpick.operators.logistic import LogisticModel, fold_moments, tag_moments
from monthpick.operators.models import prepare, score, training_rows
from monthpick.operators.smote import neighbour_recall, smote
from monthpick.plans.context import finish, inputs
from monthpick.plans.oracle_sql import ctes, rnd
from monthpick.plans.oracle_sql import peak_type as sql_peak_type
from monthpick.plans.q_metrics import fold_sql
from monthpick.plans.registry import query
from monthpick.plans.training import (
    compare_models,
    eligible_folds,
    fit_fold,
    fit_together,
    fold_scalers,
    rerun_selection,
    save_result_bundle,
    walk_forward,
)
from monthpick.schema import available_features, matrix_feature_names
from monthpick.session import materialize, scratch_path
from monthpick.sources.sinks import load_bundle, save_bundle

ELIGIBLE = "n_train_months >= 6 AND n_train_rows > 0 AND n_train_pos >= 5 AND n_val_rows > 0 AND n_val_classes >= 2"


def _dataset(spark, sf_dir, staged: bool = False):
    """Labeled dataset over the driver tables.  The trainers stage it themselves
    (partitioned by month); ``staged=True`` writes it here for direct reuse."""
    i = inputs(spark, sf_dir).stage_all()
    ds = labeled_dataset(
        i.sim_monthly, i.sim_daily, i.hist, sm_features=i.sm_features, sd_features=i.sd_features
    )
    return (materialize(ds, name="dataset") if staged else ds), i


_DONE: dict[tuple, object] = {}


def _files(spark, sf_dir) -> tuple:
    """Path, length and time of every file of the tables."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, found = [], fs.listFiles(path, True) if fs.exists(path) else None
    while found is not None and found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _once(spark, sf_dir, what: str, work):
    """Result of a training run, shared by the queries of one application that report on it while the tables are the same files (its tables are staged)."""
    key = (spark.sparkContext.applicationId, sf_dir, what, _files(spark, sf_dir))
    if key not in _DONE:
        _DONE[key] = work()
    return _DONE[key]


def _walk(spark, sf_dir, model_type: str):
    return _once(spark, sf_dir, model_type, lambda: walk_forward(_dataset(spark, sf_dir)[0], model_type))


@query("logistic_walkforward")
def q_logistic_walkforward(spark, sf_dir):
    return finish(_walk(spark, sf_dir, "logistic").folds)


@query("gbt_walkforward")
def q_gbt_walkforward(spark, sf_dir):
    return finish(_walk(spark, sf_dir, "lightgbm").folds)


@query(
    "walkforward_fold_counts",
    fold_sql(f"SELECT VAL_MONTH AS fold, n_val_rows AS n_rows, n_val_pos AS n_positive FROM elig WHERE {ELIGIBLE}"),
)
def q_walkforward_fold_counts(spark, sf_dir):
    """The scored table of the walk-forward: every eligible fold with all its rows."""
    scored = _walk(spark, sf_dir, "logistic").scored
    return scored.groupBy("fold").agg(F.count("proba").alias("n_rows"), F.sum(F.col("label").cast("long")).alias("n_positive"))


def _comparison(spark, sf_dir):
    def work():
        ds, i = _dataset(spark, sf_dir)
        return compare_models(ds, i.hist)

    return _once(spark, sf_dir, "comparison", work)


@query("model_comparison")
def q_model_comparison(spark, sf_dir):
    return finish(_comparison(spark, sf_dir)[0])


@query("model_comparison_rollup")
def q_model_comparison_rollup(spark, sf_dir):
    return finish(_comparison(spark, sf_dir)[1])


@query(
    "model_comparison_counts",
    fold_sql(
        f"""SELECT model, VAL_MONTH AS MONTH, 'fitted' AS status, n_val_rows AS n_rows, n_val_pos AS n_positive
FROM elig, (VALUES ('logistic'), ('lightgbm'), ('xgboost')) m(model) WHERE {ELIGIBLE}"""
    ),
)
def q_model_comparison_counts(spark, sf_dir):
    """Every model has every eligible fold, with all its rows."""
    return _comparison(spark, sf_dir)[0].select("model", "MONTH", "status", "n_rows", "n_positive")


_FEATS = available_features(["EID", "PEAKID", *matrix_feature_names(6), "TARGET_MONTH"])
_MOMENTS = " UNION ALL ".join(
    f"""SELECT VAL_MONTH AS fold, '{f}' AS feature, count(*) AS n, CAST(sum(IS_PROFITABLE_L) AS BIGINT) AS n_pos,
avg(CAST({f} AS DOUBLE)) AS mean, stddev_pop(CAST({f} AS DOUBLE)) AS deviation
FROM (SELECT VAL_MONTH FROM elig WHERE {ELIGIBLE}) e JOIN labeled l ON l.TARGET_MONTH < e.VAL_MONTH GROUP BY 1"""
    for f in _FEATS
)


@query(
    "fold_scaler_moments",
    fold_sql(f"SELECT fold, feature, n, n_pos, {rnd('mean', 4, 'mean')}, {rnd('deviation', 4, 'deviation')} FROM ({_MOMENTS}) x"),
)
def q_fold_scaler_moments(spark, sf_dir):
    """Each fold's scaler and class counts from sums by month."""
    ds, _ = _dataset(spark, sf_dir, staged=True)
    feat_cols = available_features(ds.columns)
    rows = training_rows(prepare(ds, feat_cols), feat_cols, F.col("TARGET_MONTH"))
    folds = fold_eligibility(ds, 6).where("eligible").select(F.col("VAL_MONTH").alias("fold"))
    out = fold_moments(tag_moments(rows, len(feat_cols)), folds)
    name = F.array(*[F.lit(c) for c in feat_cols])[F.col("feature")]
    return out.select("fold", name.alias("feature"), "n", "n_pos", snap("mean", 4).alias("mean"), snap("deviation", 4).alias("deviation"))


@query(
    "logistic_optimality",
    fold_sql(
        "SELECT VAL_MONTH AS fold, feature, 0.0::DOUBLE AS residual FROM elig, (VALUES ('intercept'), "
        + ", ".join(f"('{f}')" for f in _FEATS)
        + f") v(feature) WHERE {ELIGIBLE}"
    ),
)
def q_logistic_optimality(spark, sf_dir):
    """The equations whose only solution is the penalised, balanced model: for every fold and coefficient, the
    weighted residuals of all its training rows against the standardised feature, plus the coefficient, are 0."""
    ds, _ = _dataset(spark, sf_dir, staged=True)
    feat_cols = available_features(ds.columns)
    data, folds = prepare(ds, feat_cols), eligible_folds(ds, 6)
    fits = [fit_fold(data, feat_cols, "logistic", int(r["n_train_rows"]), int(r["n_train_pos"]), fold=r["VAL_MONTH"]) for r in folds]
    done = fit_together(fits, data)
    scalers = fold_scalers(done.rows, done.rows, [f.fold for f in fits], [], len(feat_cols))
    known = []
    for f in fits:
        model, (mean, deviation) = done.logistic[f.fold], scalers[f.fold]
        known.append((f.fold, model.intercept, model.coefficients, mean.tolist(), deviation.tolist(), f.n_rows / (2.0 * (f.n_rows - f.n_pos)), f.n_rows / (2.0 * f.n_pos)))
    models = spark.createDataFrame(known, "fold string, intercept double, c array<double>, mean array<double>, deviation array<double>, w0 double, w1 double")
    months = [r[0] for r in done.rows.select("tag").distinct().collect()]
    holds = spark.createDataFrame([(m, [f.fold for f in fits if m < f.fold]) for m in months], "tag string, folds array<string>")
    # both tables are bounded by the calendar
    rows = done.rows.join(F.broadcast(holds), "tag").select(F.explode("folds").alias("fold"), "y", "x").join(F.broadcast(models), "fold")
    eta = F.col("intercept")
    for j in range(len(feat_cols)):
        eta = eta + F.col("x")[j] * F.col("c")[j]
    wrong = (F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)) - F.col("y")) * F.when(F.col("y") > 0, F.col("w1")).otherwise(F.col("w0"))
    rows = rows.withColumn("wrong", wrong)
    part = lambda j: F.when(F.col("deviation")[j] > 0, F.col("wrong") * (F.col("x")[j] - F.col("mean")[j]) / F.col("deviation")[j]).otherwise(0.0)
    sums = rows.groupBy("fold").agg(F.sum("wrong").alias("intercept_sum"), *[F.sum(part(j)).alias(f"s{j}") for j in range(len(feat_cols))])
    sums = sums.join(F.broadcast(models), "fold")
    each = [F.struct(F.lit("intercept").alias("feature"), F.col("intercept_sum").alias("residual"))]
    each += [F.struct(F.lit(c).alias("feature"), (F.col(f"s{j}") + F.col("c")[j] * F.col("deviation")[j]).alias("residual")) for j, c in enumerate(feat_cols)]
    return sums.select("fold", F.inline(F.array(*each))).select("fold", "feature", snap("residual", 4).alias("residual"))


def _smote_last_fold(spark, sf_dir):
    """Training rows of the last eligible fold plus synthetic rows of the smaller class."""
    ds, _ = _dataset(spark, sf_dir, staged=True)
    feat_cols = available_features(ds.columns)
    last = eligible_folds(ds, 6)[-1]
    train = prepare(ds, feat_cols).where(F.col("TARGET_MONTH") < last["VAL_MONTH"])
    return smote(train, feat_cols, ["EID", "PEAKID", "TARGET_MONTH"], int(last["n_train_rows"]), int(last["n_train_pos"]))[0]


@query("smote")
def q_smote(spark, sf_dir):
    return _smote_last_fold(spark, sf_dir)


@query(
    "smote_counts",
    fold_sql(
        f"""SELECT label, greatest(n_train_pos, n_train_rows - n_train_pos)::BIGINT AS n_rows
FROM (SELECT * FROM elig WHERE {ELIGIBLE} ORDER BY fold_id DESC LIMIT 1) e, (VALUES (0), (1)) v(label)"""
    ),
)
def q_smote_counts(spark, sf_dir):
    return _smote_last_fold(spark, sf_dir).groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))


_QID = "EID || '|' || PEAKID || '|' || TARGET_MONTH"
_SQUARES = " + ".join(f"(CAST(a.{f} AS DOUBLE) - CAST(b.{f} AS DOUBLE)) * (CAST(a.{f} AS DOUBLE) - CAST(b.{f} AS DOUBLE))" for f in _FEATS)


@query(
    "smote_recall",
    fold_sql(
        f"""SELECT qid, {rnd('min(d)', 4, 'nearest')}, {rnd('max(d)', 4, 'farthest')}, TRUE AS recall_ok FROM (
  SELECT a.qid, sqrt({_SQUARES}) AS d, row_number() OVER (PARTITION BY a.qid ORDER BY sqrt({_SQUARES})) AS k
  FROM (SELECT *, {_QID} AS qid FROM labeled WHERE IS_PROFITABLE_L = 1
        AND TARGET_MONTH < (SELECT max(VAL_MONTH) FROM elig WHERE {ELIGIBLE})) b,
       (SELECT *, {_QID} AS qid FROM labeled WHERE IS_PROFITABLE_L = 1
        AND TARGET_MONTH < (SELECT max(VAL_MONTH) FROM elig WHERE {ELIGIBLE})
        AND ('0x' || substr(md5({_QID}), 1, 8))::BIGINT % 20 = 0) a
  WHERE a.qid <> b.qid) x WHERE k <= 5 GROUP BY qid"""
    ),
)
def q_smote_recall(spark, sf_dir):
    """Exact neighbour distances in the last fold's positive class for every row whose hash is divisible by 20,
    and whether the forest that SMOTE uses finds at least 0.9 of these neighbours."""
    ds, _ = _dataset(spark, sf_dir, staged=True)
    feat_cols = available_features(ds.columns)
    last = eligible_folds(ds, 6)[-1]
    positive = prepare(ds, feat_cols).where((F.col("TARGET_MONTH") < last["VAL_MONTH"]) & (F.col("label") == 1))
    qid = F.concat_ws("|", "EID", F.col("PEAKID").cast("int").cast("string"), "TARGET_MONTH")
    asked = F.conv(F.substring(F.md5(qid), 1, 8), 16, 10).cast("bigint") % 20 == 0
    found = materialize(neighbour_recall(positive, feat_cols, asked, qid), name="smote-recall")
    recall = found.agg((F.sum("hits") / F.sum(F.size("distances")) >= 0.9).alias("recall_ok")).first()[0]
    return found.select("qid", snap(F.element_at("distances", 1), 4).alias("nearest"), snap(F.element_at("distances", -1), 4).alias("farthest"), F.lit(recall).alias("recall_ok"))


#: A linear model with given coefficients, so that SQL can follow what a stored model does.
GIVEN = {"sm_ACTIVATIONLEVEL_mean": 0.03, "sm_PSM_mean": 1e-5, "sd_ACTIVATIONLEVEL_mean": -0.01, "hist_profit_rate_6m": 1.5, "PEAKID": -0.25}
GIVEN_START, GIVEN_THRESHOLD, GIVEN_LAST = -1.5, 0.45, "1998-06"
_GIVEN_PROBA = f"1.0 / (1.0 + exp(-({GIVEN_START} + " + " + ".join(f"CAST({f} AS DOUBLE) * {b!r}" for f, b in GIVEN.items()) + ")))"


def _given_bundle(spark) -> str:
    path = scratch_path(spark, "bundle")
    save_bundle(LogisticModel(list(GIVEN), GIVEN_START, list(GIVEN.values())), path, GIVEN_THRESHOLD, list(GIVEN), "logistic", GIVEN_LAST)
    return path


@query("bundle_scores", ctes("labeled") + f"SELECT TARGET_MONTH, EID, PEAKID, {rnd(_GIVEN_PROBA, 6, 'proba')} FROM labeled")
def q_bundle_scores(spark, sf_dir):
    """Every row of the dataset scored by a model that was saved and loaded."""
    ds, _ = _dataset(spark, sf_dir)
    model = load_bundle(spark, _given_bundle(spark))["model"]
    return finish(score(model, ds).select("TARGET_MONTH", "EID", F.col("PEAKID").cast("int").alias("PEAKID"), "proba"))


@query(
    "rerun_given_model",
    ctes(
        "labeled",
        extra=[
            ("months", "SELECT DISTINCT TARGET_MONTH FROM labeled ORDER BY 1 OFFSET 6"),
            ("scored", f"SELECT TARGET_MONTH, EID, PEAKID, {_GIVEN_PROBA} AS p FROM labeled WHERE TARGET_MONTH IN (FROM months)"),
            (
                "ranked",
                f"""SELECT *, row_number() OVER (PARTITION BY TARGET_MONTH ORDER BY p DESC, EID, PEAKID) AS rn,
       count(*) FILTER (WHERE p >= {GIVEN_THRESHOLD}) OVER (PARTITION BY TARGET_MONTH) AS n FROM scored""",
            ),
        ],
    )
    + f"""SELECT DISTINCT TARGET_MONTH, {sql_peak_type()} AS PEAK_TYPE, EID, TARGET_MONTH <= '{GIVEN_LAST}' AS in_sample
FROM ranked WHERE CASE WHEN n < 10 THEN rn <= 10 ELSE rn <= 100 AND p >= {GIVEN_THRESHOLD} END""",
)
def q_rerun_given_model(spark, sf_dir):
    """Rescoring by a stored bundle: every month after the first six, at its threshold."""
    ds, _ = _dataset(spark, sf_dir)
    return rerun_selection(spark, _given_bundle(spark), ds, 6)


@query("walkforward_selections")
def q_walkforward_selections(spark, sf_dir):
    return _walk(spark, sf_dir, "logistic").selections


@query("rerun_selection")
def q_rerun_selection(spark, sf_dir):
    """Train, save the bundle (MLlib model + metadata Parquet), load it back and
    rescore every month after the first six of the dataset that the training staged."""
    res = _walk(spark, sf_dir, "logistic")
    path = scratch_path(spark, "bundle")
    save_result_bundle(res, path)
    return rerun_selection(spark, path, res.dataset, 6)
