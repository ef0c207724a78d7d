"""Classifier metrics on a scored table ``(fold, proba, label)``, all folds at once.

* threshold sweep — TP / predicted-positive counts for every threshold come
  from ONE ``groupBy(fold)`` with two conditional sums per threshold (partial
  aggregation, one pass), unpivoted with ``stack``.  No threshold table is
  joined to the rows.
* best threshold — highest metric per fold, ties to the lowest threshold, 0.5
  when no threshold scores above 0 (strict ``>`` from a start of 0).
* ROC-AUC (ties count one half) and average precision (Σ ΔR·P over distinct
  score cut-offs, descending) — rows are first grouped by (fold, score), so a
  score shared by a third of all rows is one row.  Running sums are a prefix
  scan over a distributed sort of the distinct scores: each task adds up along
  its part of the sort, and the parts' totals give what is before it.  The sort
  cuts by (fold, score), so scores that crowd near 0 spread over tasks like any
  others.  A single-class fold gives 0.0.
* classification report, evaluation rows, expanding means, fold rollups.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthpick.functions.columns import f1_from, safe_ratio
from monthpick.schema import DEFAULT_THRESHOLD, sweep_thresholds
from monthpick.session import materialize

# functions sent to executors carry this module, which need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _stack(df: DataFrame, keep: list[str], items: list[tuple[str, list[str]]], names: list[str]) -> DataFrame:
    """Unpivot: one output row per item = (label, *columns)."""
    parts = []
    for label, cols in items:
        parts.append(f"'{label}'")
        parts.extend(f"`{c}`" for c in cols)
    expr = f"stack({len(items)}, {', '.join(parts)}) AS ({', '.join(names)})"
    return df.selectExpr(*[f"`{k}`" for k in keep], expr)


def threshold_counts(
    scored: DataFrame,
    thresholds: list[float] | None = None,
    fold: str = "fold",
    proba: str = "proba",
    label: str = "label",
) -> DataFrame:
    """(fold, threshold, TP, FP, FN, n_pos, n) for every threshold."""
    ts = thresholds or sweep_thresholds()
    # NaN is above every number in Spark; a missing score is not a hit
    p, y = F.nanvl(F.col(proba).cast("double"), F.lit(float("-inf"))), F.col(label).cast("long")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos"), F.sum((p >= DEFAULT_THRESHOLD).cast("long")).alias("PP_DEFAULT")]
    for j, t in enumerate(ts):
        hit = (p >= F.lit(float(t))).cast("long")
        aggs.append(F.sum(hit * y).alias(f"tp{j}"))
        aggs.append(F.sum(hit).alias(f"pp{j}"))
    wide = scored.groupBy(fold).agg(*aggs)
    wide = wide.select(fold, "n", "n_pos", "PP_DEFAULT", *[F.lit(float(t)).alias(f"t{j}") for j, t in enumerate(ts)],
                       *[f"tp{j}" for j in range(len(ts))], *[f"pp{j}" for j in range(len(ts))])
    long = wide.selectExpr(
        fold,
        "n",
        "n_pos",
        "PP_DEFAULT",
        f"stack({len(ts)}, " + ", ".join(f"t{j}, tp{j}, pp{j}" for j in range(len(ts))) + ") AS (threshold, TP, PP)",
    )
    return long.select(
        fold,
        "threshold",
        "TP",
        (F.col("PP") - F.col("TP")).alias("FP"),
        (F.col("n_pos") - F.col("TP")).alias("FN"),
        "n_pos",
        "n",
        "PP_DEFAULT",  # predicted positives at the default threshold
    )


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    p = safe_ratio(tp, tp + fp)
    r = safe_ratio(tp, tp + fn)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1_from(p, r))


def threshold_sweep(scored: DataFrame, thresholds=None, fold="fold", proba="proba", label="label") -> DataFrame:
    return with_rates(threshold_counts(scored, thresholds, fold, proba, label)).drop("PP_DEFAULT")


def tuned_counts(counts: DataFrame, metric: str = "f1", fold: str = "fold") -> DataFrame:
    """Per fold the best threshold of ``threshold_counts`` with its TP, FP, FN: nothing is counted again.

    Where no threshold scores above 0 (no true positive at any), the default
    threshold stands, at which there are PP_DEFAULT predicted positives.
    """
    m = metric if metric in ("f1", "precision", "recall") else "f1"
    scored = with_rates(counts)
    order = F.struct(F.col(m).alias("v"), (-F.col("threshold")).alias("nt"), "TP", "FP", "FN")
    best = scored.groupBy(fold).agg(F.max(F.when(F.col(m) > 0, order)).alias("b"), F.first("PP_DEFAULT").alias("PP_DEFAULT"), F.first("n_pos").alias("n_pos"))
    some = F.col("b").isNotNull()
    return best.select(
        fold,
        F.when(some, -F.col("b.nt")).otherwise(DEFAULT_THRESHOLD).alias("threshold"),
        F.when(some, F.col("b.TP")).otherwise(F.lit(0)).alias("TP"),
        F.when(some, F.col("b.FP")).otherwise(F.col("PP_DEFAULT")).alias("FP"),
        F.when(some, F.col("b.FN")).otherwise(F.col("n_pos")).alias("FN"),
    )


def best_threshold(sweep: DataFrame, metric: str = "f1", fold: str = "fold") -> DataFrame:
    """Per fold: threshold with the highest metric (> 0), lowest on ties; 0.5 if none."""
    m = metric if metric in ("f1", "precision", "recall") else "f1"
    best = sweep.where(F.col(m) > 0).groupBy(fold).agg(
        F.max(F.struct(F.col(m).alias("v"), (-F.col("threshold")).alias("nt"))).alias("__b")
    )
    folds = sweep.select(fold).distinct()
    out = folds.join(best, fold, "left")
    return out.select(
        fold,
        F.coalesce(-F.col("__b").getField("nt"), F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce(F.col("__b").getField("v"), F.lit(0.0)).alias("score"),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (fold, s, pos_s, n_s, part) with running sums of pos_s and n_s inside each fold of a sorted partition."""
    carried, tp, n = (), 0, 0
    for batch in batches:
        fold, pos, rows = batch.column(0), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        a, b = fold.slice(0, len(fold) - 1), fold.slice(1)
        same = pc.if_else(pc.is_null(a), pc.is_null(b), pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, ~same])
        runs = np.diff(np.r_[starts, len(fold)])
        tp_in, n_in = np.cumsum(pos), np.cumsum(rows)
        before = lambda total, values: np.repeat(total[starts] - values[starts], runs)
        tp_in, n_in = tp_in - before(tp_in, pos), n_in - before(n_in, rows)
        first, last = fold[0].as_py(), fold[len(fold) - 1].as_py()
        if carried == (first,):
            tp_in[: runs[0]] += tp
            n_in[: runs[0]] += n
        carried, tp, n = (last,), int(tp_in[-1]), int(n_in[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tp_in), pa.array(n_in)], names=[*batch.schema.names, "tp_in", "n_in"])


def _score_groups(scored: DataFrame, fold: str, proba: str, label: str) -> DataFrame:
    """(fold, s, pos_s, neg_s, tp_s, n_ge) per distinct score: a prefix scan over the scores in falling order.

    Distinct scores are sorted by (fold, score) over all tasks; each task adds up
    along its part, the parts' totals (one row for each fold in a partition of
    the sort) give what is before it, and that is added back.  The sorted scores
    are staged, so they are grouped and sorted once for all measures.
    """
    y = F.col(label).cast("long")
    g = scored.groupBy(F.col(fold).alias("fold"), F.col(proba).alias("s")).agg(F.sum(y).alias("pos_s"), F.count(F.lit(1)).alias("n_s"))
    g = g.orderBy("fold", F.col("s").desc()).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{c}` {t}" for c, t in [*g.dtypes, ("tp_in", "bigint"), ("n_in", "bigint")])
    run = materialize(g.mapInArrow(_running, schema), name="score-groups")
    totals = run.groupBy("fold", "part").agg(F.max("tp_in").alias("tp"), F.max("n_in").alias("n"))
    w = Window.partitionBy("fold").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    before = totals.select(F.col("fold").alias("f"), F.col("part").alias("p"), F.coalesce(F.sum("tp").over(w), zero).alias("pos_hi"), F.coalesce(F.sum("n").over(w), zero).alias("n_hi"))
    # at most a row for each fold and one more for each partition of the sort
    out = run.join(F.broadcast(before), F.col("fold").eqNullSafe(F.col("f")) & (F.col("part") == F.col("p")))
    return out.select(
        F.col("fold").alias(fold),
        "s",
        "pos_s",
        (F.col("n_s") - F.col("pos_s")).alias("neg_s"),
        (F.col("pos_hi") + F.col("tp_in")).alias("tp_s"),  # positives with score >= s
        (F.col("n_hi") + F.col("n_in")).alias("n_ge"),  # rows with score >= s
    )


def ranking_metrics(scored: DataFrame, fold="fold", proba="proba", label="label") -> DataFrame:
    """ROC-AUC and average precision per fold from ONE pass of score groups."""
    g = _score_groups(scored, fold, proba, label)
    above = F.col("tp_s") - F.col("pos_s")
    agg = g.groupBy(fold).agg(
        F.sum(F.col("neg_s") * (above + F.col("pos_s") / 2.0)).alias("__u"),
        F.sum(F.col("pos_s") * (F.col("tp_s") / F.col("n_ge"))).alias("__a"),
        F.sum("pos_s").alias("__p"),
        F.sum("neg_s").alias("__n"),
    )
    ok = (F.col("__p") > 0) & (F.col("__n") > 0)
    return agg.select(
        fold,
        F.when(ok, F.col("__u") / (F.col("__p") * F.col("__n"))).otherwise(0.0).alias("roc_auc"),
        F.when(ok, F.col("__a") / F.col("__p")).otherwise(0.0).alias("pr_auc"),
    )


def roc_auc(scored: DataFrame, fold="fold", proba="proba", label="label") -> DataFrame:
    """Tie-aware ROC-AUC per fold; 0.0 for a single-class fold."""
    g = _score_groups(scored, fold, proba, label)
    above = F.col("tp_s") - F.col("pos_s")  # positives strictly above s
    agg = g.groupBy(fold).agg(
        F.sum(F.col("neg_s") * (above + F.col("pos_s") / 2.0)).alias("__u"),
        F.sum("pos_s").alias("__p"),
        F.sum("neg_s").alias("__n"),
    )
    ok = (F.col("__p") > 0) & (F.col("__n") > 0)
    return agg.select(fold, F.when(ok, F.col("__u") / (F.col("__p") * F.col("__n"))).otherwise(0.0).alias("roc_auc"))


def average_precision(scored: DataFrame, fold="fold", proba="proba", label="label") -> DataFrame:
    """Σ over distinct cut-offs of (pos_s / P) · precision(>= s); 0.0 if single-class."""
    g = _score_groups(scored, fold, proba, label)
    agg = g.groupBy(fold).agg(
        F.sum(F.col("pos_s") * (F.col("tp_s") / F.col("n_ge"))).alias("__a"),
        F.sum("pos_s").alias("__p"),
        F.sum("neg_s").alias("__n"),
    )
    ok = (F.col("__p") > 0) & (F.col("__n") > 0)
    return agg.select(fold, F.when(ok, F.col("__a") / F.col("__p")).otherwise(0.0).alias("pr_auc"))


def counts_at(scored: DataFrame, thresholds: DataFrame, fold="fold", proba="proba", label="label") -> DataFrame:
    """Confusion counts per fold at that fold's threshold (one row per fold; the optimizer sizes that side)."""
    j = scored.join(thresholds.select(fold, "threshold"), fold)
    pred = (F.nanvl(F.col(proba).cast("double"), F.lit(float("-inf"))) >= F.col("threshold")).cast("long")
    y = F.col(label).cast("long")
    return j.groupBy(fold, "threshold").agg(
        F.sum(pred * y).alias("TP"),
        F.sum(pred * (1 - y)).alias("FP"),
        F.sum((1 - pred) * y).alias("FN"),
        F.sum((1 - pred) * (1 - y)).alias("TN"),
    )


def classification_report(scored: DataFrame, thresholds: DataFrame, fold="fold", proba="proba", label="label") -> DataFrame:
    """Per fold: classes 0 and 1, accuracy, macro avg, weighted avg (zero_division=0)."""
    c = counts_at(scored, thresholds, fold, proba, label)
    tp, fp, fn, tn = (F.col(x) for x in ("TP", "FP", "FN", "TN"))
    p1, r1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    p0, r0 = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp)
    c = c.select(
        fold,
        p0.alias("p0"), r0.alias("r0"), f1_from(p0, r0).alias("f0"), (tn + fp).cast("double").alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1_from(p1, r1).alias("f1"), (tp + fn).cast("double").alias("s1"),
        ((tp + tn) / (tp + tn + fp + fn)).alias("acc"),
    )
    tot = F.col("s0") + F.col("s1")
    c = c.select(
        "*",
        ((F.col("p0") + F.col("p1")) / 2).alias("mp"),
        ((F.col("r0") + F.col("r1")) / 2).alias("mr"),
        ((F.col("f0") + F.col("f1")) / 2).alias("mf"),
        safe_ratio(F.col("p0") * F.col("s0") + F.col("p1") * F.col("s1"), tot).alias("wp"),
        safe_ratio(F.col("r0") * F.col("s0") + F.col("r1") * F.col("s1"), tot).alias("wr"),
        safe_ratio(F.col("f0") * F.col("s0") + F.col("f1") * F.col("s1"), tot).alias("wf"),
        tot.alias("st"),
        F.lit(None).cast("double").alias("na"),
    )
    return _stack(
        c,
        [fold],
        [
            ("0", ["p0", "r0", "f0", "s0"]),
            ("1", ["p1", "r1", "f1", "s1"]),
            ("accuracy", ["na", "na", "acc", "st"]),
            ("macro avg", ["mp", "mr", "mf", "st"]),
            ("weighted avg", ["wp", "wr", "wf", "st"]),
        ],
        ["class", "precision", "recall", "f1_score", "support"],
    )


def previous_fold_thresholds(best: DataFrame, initial: float, fold: str = "fold") -> DataFrame:
    """Each fold uses the threshold tuned on the fold before it (folds ordered
    by name = month); the first fold uses ``initial``.  One row per fold."""
    w = Window.orderBy(fold)  # one row per fold: calendar-bounded
    return best.select(fold, F.coalesce(F.lag("threshold").over(w), F.lit(float(initial))).alias("threshold"))


def evaluation_rows(
    scored: DataFrame,
    metric: str = "f1",
    thresholds=None,
    fold="fold",
    proba="proba",
    label="label",
    tune_on: str = "same_fold",
    initial_threshold: float = 0.3,
) -> DataFrame:
    """label, threshold (tuned per fold), f1, precision, recall, roc_auc, pr_auc,
    n_positive_pred, n_positive_true — one row per fold.

    ``tune_on='same_fold'`` tunes and evaluates on the same fold (reference
    behaviour, optimistic); ``'previous_fold'`` evaluates each fold at the
    threshold tuned on the previous one."""
    c = tuned_counts(threshold_counts(scored, thresholds, fold, proba, label), metric, fold)
    if tune_on == "previous_fold":
        c = counts_at(scored, previous_fold_thresholds(c, initial_threshold, fold), fold, proba, label)
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    rows = c.select(
        fold,
        "threshold",
        f1_from(p, r).alias("f1"),
        p.alias("precision"),
        r.alias("recall"),
        (tp + fp).alias("n_positive_pred"),
        (tp + fn).alias("n_positive_true"),
    )
    return rows.join(ranking_metrics(scored, fold, proba, label), fold).withColumnRenamed(fold, "label")


def expanding_mean(rows: DataFrame, order: str = "label", cols=("f1", "pr_auc")) -> DataFrame:
    """Running mean over folds in order (one row per fold: calendar-bounded)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(order, *[F.avg(c).over(w).alias(f"avg_{c}") for c in cols])


def fold_rollup(rows: DataFrame, metrics=("f1", "precision", "recall", "pr_auc")) -> DataFrame:
    """mean / sample std / min / max of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}__mean"), F.stddev_samp(m).alias(f"{m}__std"),
                 F.min(m).alias(f"{m}__min"), F.max(m).alias(f"{m}__max")]
    wide = rows.agg(*aggs)
    return _stack(
        wide,
        [],
        [(m, [f"{m}__mean", f"{m}__std", f"{m}__min", f"{m}__max"]) for m in metrics],
        ["metric", "mean", "std", "min", "max"],
    )
