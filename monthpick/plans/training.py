"""Walk-forward training, model comparison and rescoring with a saved bundle.

The labeled dataset is a stage boundary (a written table).  Folds come from
``fold_eligibility`` — one row per calendar month, so the fold list the driver
goes through is bounded by the calendar, not by the data.  The fits of all folds
(and models) are trained together (``fit_together``): one staged, hashed table
of rows, from which each operator takes what it adds up.  Their validation
scores are staged, and every post-fit measure (threshold sweep, tuned threshold,
ROC-AUC, average precision, selections) is then ONE grouped query over all folds.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.functions.columns import peak_type
from monthpick.operators import boosting, logistic
from monthpick.operators.folds import fold_eligibility
from monthpick.operators.metrics import evaluation_rows, expanding_mean, fold_rollup
from monthpick.operators.models import GBT_TREES, LOGISTIC_MAX_ITER, MODEL_TYPES, prepare, score, training_rows
from monthpick.operators.selection import as_opportunities, topk_with_floor
from monthpick.operators.smote import smote
from monthpick.schema import MAX_K, MIN_K, MIN_TRAIN_MONTHS, available_features
from monthpick.session import materialize
from monthpick.sources.sinks import load_bundle, save_bundle

log = logging.getLogger(__name__)

# SMOTE runs at a time
PARALLEL_FITS = 4
#: Name of the fold of a fit that stands alone: it sorts behind all months.
ALONE = "~"


@dataclass
class FoldFit:
    """A fold's fit.  It is trained with others by ``fit_together``, or alone when its model is first used."""

    train: DataFrame
    feat_cols: list[str]
    model_type: str
    n_rows: int
    n_pos: int
    weight: float
    n_trees: int
    max_iter: int
    fold: str | None
    oversampled: bool
    model: object = None

    def fitted(self):
        if self.model is None:
            self.model = fit_together([self], None).model(self)
        return self.model

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        return self.fitted().score(df, out)

    def to_row(self) -> dict:
        return self.fitted().to_row()


def fit_fold(
    train: DataFrame,
    feat_cols: list[str],
    model_type: str,
    n_rows: int,
    n_pos: int,
    use_smote: bool = False,
    n_trees: int = GBT_TREES,
    max_iter: int = LOGISTIC_MAX_ITER,
    weight_with_smote: bool = False,
    fold: str | None = None,
) -> FoldFit:
    """The fit of a fold's training rows (``label`` double).  ``fold``: its validation month, before which all its rows are.

    ``weight_with_smote`` keeps the positive weight of the rows before SMOTE for
    boosted trees, as the reference does; otherwise the two are alternatives."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"Unknown model: {model_type}")
    weight = (n_rows - n_pos) / n_pos if n_pos else 1.0
    if use_smote:
        train, n_rows, n_pos = smote(train, feat_cols, ["EID", "PEAKID", "TARGET_MONTH"], n_rows, n_pos)
        weight = weight if weight_with_smote else 1.0
    return FoldFit(train, list(feat_cols), model_type, n_rows, n_pos, weight, n_trees, max_iter, fold, use_smote)


@dataclass
class FittedFolds:
    """Models of several fits, and the scores of their folds' validation rows."""

    feat_cols: list[str]
    rows: DataFrame  # tag, y, x, key, deal, EID, PEAKID
    logistic: dict[str, logistic.LogisticModel] = field(default_factory=dict)
    boosted: DataFrame | None = None
    edges: dict[str, list[np.ndarray]] = field(default_factory=dict)
    depth: int = boosting.LIGHTGBM.depth

    def model(self, fit: FoldFit):
        """One fit's model, on the driver (its size is bounded by its rounds)."""
        fold = fit.fold or ALONE
        if fit.model_type == "logistic":
            return self.logistic[fold]
        rows = self.boosted.where((F.col("fold") == fold) & (F.col("model") == fit.model_type)).collect()
        return boosting.BoostedTrees.of(rows, self.feat_cols, self.edges[fold], self.depth)

    def scored(self, n_val: dict[str, int]) -> DataFrame:
        """model, fold, EID, PEAKID, proba, label of every fold's validation rows (those of its month)."""
        spark = self.rows.sparkSession
        folds = spark.createDataFrame([(f,) for f in n_val], "fold string")  # a row for each fold
        val = self.rows.withColumnRenamed("tag", "fold").join(F.broadcast(folds), "fold", "left_semi")
        parts = []
        if self.logistic:
            known = [(f, m.intercept, m.coefficients) for f, m in self.logistic.items()]
            models = spark.createDataFrame(known, "fold string, intercept double, c array<double>")  # a row for each fold
            eta = F.col("intercept")
            for j in range(len(self.feat_cols)):
                eta = eta + F.col("x")[j] * F.col("c")[j]
            proba = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
            parts.append(val.join(F.broadcast(models), "fold").select(F.lit("logistic").alias("model"), "fold", "EID", "PEAKID", proba.alias("proba"), F.col("y").alias("label")))
        if self.boosted is not None:
            parts.append(boosting.score_folds(val, self.boosted, self.edges, self.depth, n_val))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def fit_together(fits: list[FoldFit], data: DataFrame | None, staged: bool = False) -> FittedFolds:
    """Train all fits on ``data`` (prepared rows with TARGET_MONTH): a fit's rows are those before its fold's month.

    A fit of oversampled rows trains on its own table; so does the only fit of ``data`` None.
    ``staged``: ``data`` is a staged table in the order of its months, and logistic fits read it as it is.
    """
    feat_cols = fits[0].feat_cols
    if data is None:
        base = training_rows(fits[0].train, feat_cols, F.lit(""))
    else:
        base = training_rows(data, feat_cols, F.col("TARGET_MONTH").cast("string"))
    own = {f"smote {f.fold or ALONE}": f for f in fits if f.oversampled and data is not None}
    for tag, fit in own.items():
        base = base.unionByName(training_rows(fit.train, feat_cols, F.lit(tag)))
    lean = staged and data is not None and not own and all(f.model_type == "logistic" for f in fits)
    rows = base if lean else materialize(base.sortWithinPartitions("tag"), name="training-rows")
    spark, n = rows.sparkSession, len(feat_cols)
    months = rows.where(~F.col("tag").startswith("smote "))
    out = FittedFolds(feat_cols, months)
    plain = {f.fold or ALONE for f in fits if not (f.oversampled and data is not None)}
    # tags and folds are months: both lists are bounded by the calendar
    tags = [r[0] for r in rows.select("tag").distinct().collect()]
    members = {t: [own[t].fold or ALONE] if t in own else sorted(f for f in plain if t < f) for t in tags}

    linear = {f.fold or ALONE: logistic.LogisticFit(f.n_rows, f.n_pos, f.max_iter) for f in sorted(fits, key=lambda f: f.fold or ALONE) if f.model_type == "logistic"}
    if linear:
        moments = fold_scalers(rows, months, sorted(plain & set(linear)), [t for t in own if (own[t].fold or ALONE) in linear], n)
        linear = {f: x for f, x in linear.items() if f in moments}
        out.logistic = logistic.fit_logistic(rows, linear, members, moments, feat_cols)

    trees = [f for f in fits if f.model_type != "logistic"]
    if trees:
        units = [
            boosting.Unit(f.fold or ALONE, f.model_type, replace(boosting.PROFILES[f.model_type], trees=f.n_trees), f.weight, f.n_rows, f.n_pos) for f in trees
        ]
        folds = sorted({u.fold for u in units})
        out.edges = boosting.bin_edges(months, n, folds)
        of_tag = spark.createDataFrame([(t, [f for f in m if f in set(folds)]) for t, m in members.items()], "tag string, folds array<string>")
        dealt = rows.join(F.broadcast(of_tag), "tag").select(F.explode("folds").alias("fold"), "key", "deal", "y", "x")
        n_blocks = {u.fold: boosting.count_blocks(u.n) for u in units}
        blocks = materialize(boosting.pack_blocks(dealt, out.edges, n_blocks), name="blocks")
        out.boosted = boosting.fit_units(blocks, units, n_blocks, n)
    return out


def fold_scalers(rows: DataFrame, months: DataFrame, folds: list[str], own_tags: list[str], n_features: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of the features over each fold's training rows (numbers for each fold reach the driver)."""
    spark = rows.sparkSession
    found = []
    if folds:
        table = spark.createDataFrame([(f,) for f in folds], "fold string")
        found += logistic.fold_moments(logistic.tag_moments(months, n_features), table).collect()
    if own_tags:
        found += logistic.own_moments(logistic.tag_moments(rows.where(F.col("tag").isin(own_tags)), n_features)).collect()
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in found:
        mean, deviation = out.setdefault(r["fold"].removeprefix("smote "), (np.zeros(n_features), np.zeros(n_features)))
        mean[r["feature"]], deviation[r["feature"]] = r["mean"], r["deviation"]
    return out


def eligible_folds(ds: DataFrame, min_train_months: int) -> list:
    """Driver-side fold list (one small row per fold, calendar-bounded)."""
    return fold_eligibility(ds, min_train_months).where(F.col("eligible")).orderBy("fold_id").collect()


def _side_by_side(work, items: list, parallelism: int) -> list:
    """Results of ``work`` in order; Spark runs the jobs of several items together."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(work, items))


def select_per_fold(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Model selection for every fold at its own threshold (>= 10 above it ->
    first 100 of them, else top 10)."""
    # thresholds: one row per fold, and a fold is a month
    s = scored.join(F.broadcast(thresholds), "fold").withColumnRenamed("fold", "TARGET_MONTH")
    picked = topk_with_floor(s, "proba", F.col("threshold"), MAX_K, MIN_K)
    return as_opportunities(picked)


@dataclass
class WalkForwardResult:
    folds: DataFrame
    rollup: DataFrame
    expanding: DataFrame
    selections: DataFrame
    scored: DataFrame
    model: object | None
    threshold: float
    feat_cols: list[str]
    model_type: str
    last_train_month: str | None
    dataset: DataFrame | None = None  # staged


def walk_forward(
    ds: DataFrame,
    model_type: str = "lightgbm",
    use_smote: bool = False,
    min_train_months: int = MIN_TRAIN_MONTHS,
    n_trees: int = GBT_TREES,
    max_iter: int = LOGISTIC_MAX_ITER,
    metric: str = "f1",
    tune_on: str = "same_fold",
    parallelism: int = PARALLEL_FITS,
    weight_with_smote: bool = False,
) -> WalkForwardResult:
    """Expanding-window folds: train on months < val, tune the threshold and
    evaluate on val (on the same fold, as in the reference), select per fold.
    ``parallelism``: SMOTE runs at a time."""
    spark = ds.sparkSession
    # logistic fits all read the whole table, and read it as it is staged; otherwise it is staged for per-fold pruning
    lean = model_type == "logistic" and not use_smote
    ds = materialize(ds.sortWithinPartitions("TARGET_MONTH"), name="dataset") if lean else materialize(ds, name="dataset", partition_by="TARGET_MONTH")
    feat_cols = available_features(ds.columns)
    data = prepare(ds, feat_cols)
    folds = eligible_folds(ds, min_train_months)
    if not folds:
        empty = spark.createDataFrame([], "fold string, EID string, PEAKID int, proba double, label int")
        rows = evaluation_rows(empty, metric)
        return WalkForwardResult(rows, fold_rollup(rows), expanding_mean(rows), as_opportunities(
            empty.withColumnRenamed("fold", "TARGET_MONTH")), empty, None, 0.3, feat_cols, model_type, None, ds)

    def fit(row) -> FoldFit:
        train = data.where(F.col("TARGET_MONTH") < row["VAL_MONTH"])
        return fit_fold(
            train, feat_cols, model_type, int(row["n_train_rows"]), int(row["n_train_pos"]), use_smote, n_trees, max_iter,
            weight_with_smote, fold=row["VAL_MONTH"],
        )

    fits = _side_by_side(fit, folds, parallelism if use_smote else 1)
    done = fit_together(fits, data, staged=lean)
    n_val = {r["VAL_MONTH"]: int(r["n_val_rows"]) for r in folds}
    scored_all = materialize(done.scored(n_val).drop("model"), name=f"scored-{model_type}")
    last_val, last_train = folds[-1]["VAL_MONTH"], folds[-1]["TRAIN_LAST"]
    model = done.model(fits[-1])
    rows = materialize(evaluation_rows(scored_all, metric, tune_on=tune_on), name="fold-metrics")
    thresholds = rows.select(F.col("label").alias("fold"), "threshold")
    final_threshold = rows.where(F.col("label") == last_val).select("threshold").first()[0]
    return WalkForwardResult(
        folds=rows,
        rollup=fold_rollup(rows),
        expanding=expanding_mean(rows),
        selections=select_per_fold(scored_all, thresholds),
        scored=scored_all,
        model=model,
        threshold=float(final_threshold),
        feat_cols=feat_cols,
        model_type=model_type,
        last_train_month=last_train,
        dataset=ds,
    )


def compare_models(
    ds: DataFrame,
    hist_profit: DataFrame,
    model_types=("logistic", "lightgbm", "xgboost"),
    min_train_months: int = MIN_TRAIN_MONTHS,
    n_trees: int = GBT_TREES,
    max_iter: int = LOGISTIC_MAX_ITER,
) -> tuple[DataFrame, DataFrame]:
    """Same folds for every model.  Returns the long table (model, MONTH, status,
    n_rows, n_positive, f1, precision, recall, pr_auc, net_profit) with one row for
    each model and fold, and the per-model rollup.  A model that cannot be fitted to a fold's
    data (invalid argument) has that as its status and null measures; any other
    failure, such as a lost executor, ends the comparison."""
    spark = ds.sparkSession
    ds = materialize(ds, name="dataset", partition_by="TARGET_MONTH")  # per-fold pruning
    feat_cols = available_features(ds.columns)
    data = prepare(ds, feat_cols)
    folds, fits, done = eligible_folds(ds, min_train_months), [], []
    for row in folds:
        val = row["VAL_MONTH"]
        train = data.where(F.col("TARGET_MONTH") < val)
        for mt in model_types:
            try:
                fits.append(fit_fold(train, feat_cols, mt, int(row["n_train_rows"]), int(row["n_train_pos"]), False, n_trees, max_iter, fold=val))
                done.append((mt, val, "fitted"))
            except (IllegalArgumentException, ValueError) as e:
                log.warning("%s does not fit %s: %s", mt, val, e)
                done.append((mt, val, f"not fitted: {e}"[:200]))
    if not fits:
        raise ValueError("no eligible fold")
    statuses = spark.createDataFrame(done, "model string, MONTH string, status string")  # one row for each model and month
    together = fit_together(fits, data)
    scored = materialize(together.scored({r["VAL_MONTH"]: int(r["n_val_rows"]) for r in folds}), name="scored-compare")
    scored = scored.withColumn("mf", F.concat_ws("|", "model", "fold"))
    rows = evaluation_rows(scored, fold="mf")
    thresholds = rows.select(F.col("label").alias("mf"), "threshold")
    sel = topk_with_floor(  # thresholds: one row for each model and month
        scored.join(F.broadcast(thresholds), "mf"), "proba", F.col("threshold"), MAX_K, MIN_K, group="mf"
    ).select("mf", F.col("fold").alias("TARGET_MONTH"), "PEAKID", "EID")
    sel = sel.select("mf", "TARGET_MONTH", peak_type("PEAKID").alias("PEAK_TYPE"), "EID").dropDuplicates()
    profit = _matched_profit_per_group(sel, hist_profit)
    counts = scored.groupBy(F.col("mf").alias("c_mf")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("label").cast("long")).alias("n_positive"))
    long = rows.join(counts, rows["label"] == F.col("c_mf")).join(profit, rows["label"] == profit["mf"], "left").select(
        F.split(rows["label"], r"\|").getItem(0).alias("model"),
        F.split(rows["label"], r"\|").getItem(1).alias("MONTH"),
        "n_rows",
        "n_positive",
        "f1",
        "precision",
        "recall",
        "pr_auc",
        F.coalesce(F.col("matched_profit"), F.lit(0.0)).alias("net_profit"),
    )
    order = ["model", "MONTH", "status", "n_rows", "n_positive", "f1", "precision", "recall", "pr_auc", "net_profit"]
    long = materialize(statuses.join(long, ["model", "MONTH"], "left").select(*order), name="comparison")
    rollup = long.groupBy("model").agg(
        F.avg("f1").alias("mean_f1"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("pr_auc").alias("mean_pr_auc"),
        F.sum("net_profit").alias("net_profit"),
        F.count("f1").alias("n_folds"),
    )
    return long, rollup


def _matched_profit_per_group(sel: DataFrame, hist_profit: DataFrame) -> DataFrame:
    """Σ profit of label rows of the fold month whose (PEAK_TYPE, EID) is selected."""
    from monthpick.operators.evaluation import truth_rows

    truth = truth_rows(hist_profit)
    j = truth.join(sel, ["TARGET_MONTH", "PEAK_TYPE", "EID"], "inner")
    return j.groupBy("mf").agg(F.sum("PROFIT").alias("matched_profit"))


def save_result_bundle(res: WalkForwardResult, path: str) -> None:
    if res.model is None:
        raise ValueError("no model to save")
    save_bundle(res.model, path, res.threshold, res.feat_cols, res.model_type, res.last_train_month)


def rerun_selection(spark, bundle_path: str, ds: DataFrame, min_train_months: int = MIN_TRAIN_MONTHS) -> DataFrame:
    """Rescore every month after the first ``min_train_months`` with a saved
    bundle; absent model features are filled with 0.  ``in_sample`` marks months
    the model was trained on (null for a bundle that does not say)."""
    from monthpick.operators.dataset import fill_missing_features

    b = load_bundle(spark, bundle_path)
    # distinct target months present (one row per month: calendar-bounded)
    present = [r[0] for r in ds.select("TARGET_MONTH").distinct().orderBy("TARGET_MONTH").collect()]
    if len(present) <= min_train_months:
        return spark.createDataFrame([], "TARGET_MONTH string, PEAK_TYPE string, EID string, in_sample boolean")
    first_val = present[min_train_months]
    x = fill_missing_features(ds, b["feat_cols"], keep=["EID", "TARGET_MONTH"]).where(
        F.col("TARGET_MONTH") >= F.lit(first_val)
    )
    x = x.withColumn("PEAKID_KEY", F.col("PEAKID").cast("int"))
    scored = score(b["model"], x).drop("PEAKID").withColumnRenamed("PEAKID_KEY", "PEAKID")
    picked = topk_with_floor(scored, "proba", b["threshold"], MAX_K, MIN_K)
    return as_opportunities(picked).withColumn("in_sample", F.col("TARGET_MONTH") <= F.lit(b["last_train_month"]).cast("string"))

