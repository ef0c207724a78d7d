"""Classifier metrics vs brute force, threshold tuning edge cases, folds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from monthpick.operators.folds import fold_eligibility, fold_map
from monthpick.operators.metrics import (
    _score_groups,
    average_precision,
    best_threshold,
    classification_report,
    roc_auc,
    threshold_sweep,
)


def brute_auc(ps, ys):
    pos = [p for p, y in zip(ps, ys) if y == 1]
    neg = [p for p, y in zip(ps, ys) if y == 0]
    if not pos or not neg:
        return 0.0
    u = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return u / (len(pos) * len(neg))


def brute_ap(ps, ys):
    P = sum(ys)
    if P == 0 or P == len(ys):
        return 0.0
    total = 0.0
    for s in sorted(set(ps), reverse=True):
        pos_s = sum(1 for p, y in zip(ps, ys) if p == s and y == 1)
        tp = sum(1 for p, y in zip(ps, ys) if p >= s and y == 1)
        n = sum(1 for p in ps if p >= s)
        total += pos_s / P * tp / n
    return total


@pytest.fixture
def scored(spark):
    rng = random.Random(7)
    rows = []
    for f in range(3):
        for i in range(300):
            y = 1 if rng.random() < 0.2 else 0
            p = round(min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * y, 0.2))), 2)  # many ties
            rows.append((f"F{f}", f"E{i}", 0, p, y))
    rows += [("SINGLE", f"E{i}", 0, 0.1 * (i % 10), 0) for i in range(20)]
    return spark.createDataFrame(rows, "fold string, EID string, PEAKID int, proba double, label int"), rows


def test_roc_and_ap_match_brute_force(scored):
    df, rows = scored
    auc = dict(roc_auc(df).collect())
    ap = dict(average_precision(df).collect())
    for f in ("F0", "F1", "F2", "SINGLE"):
        ps = [r[3] for r in rows if r[0] == f]
        ys = [r[4] for r in rows if r[0] == f]
        assert auc[f] == pytest.approx(brute_auc(ps, ys), abs=1e-12)
        assert ap[f] == pytest.approx(brute_ap(ps, ys), abs=1e-12)
    assert auc["SINGLE"] == 0.0 and ap["SINGLE"] == 0.0


def test_scores_spanning_many_values(spark):
    rows = [("F", f"E{i}", 0, (i % 3000) / 2999.0 if i < 3000 else 0.5 + i / (16.0 * 512), i % 3 == 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "fold string, EID string, PEAKID int, proba double, label boolean")
    df = df.withColumn("label", F.col("label").cast("int"))
    ps, ys = [r[3] for r in rows], [int(r[4]) for r in rows]
    assert roc_auc(df).first()[1] == pytest.approx(brute_auc(ps, ys), abs=1e-12)


def test_sweep_ties_pick_lowest_and_default(spark):
    # every threshold up to 0.5 gives the same confusion -> lowest (0.05) wins
    rows = [("T", "a", 0, 0.6, 1), ("T", "b", 0, 0.55, 1), ("T", "c", 0, 0.01, 0)]
    # no positive predictions at any threshold above 0 score -> 0.5
    rows += [("Z", "a", 0, 0.01, 1), ("Z", "b", 0, 0.01, 0)]
    df = spark.createDataFrame(rows, "fold string, EID string, PEAKID int, proba double, label int")
    best = {r["fold"]: (r["threshold"], r["score"]) for r in best_threshold(threshold_sweep(df)).collect()}
    assert best["T"] == (pytest.approx(0.05), 1.0)
    assert best["Z"] == (0.5, 0.0)


def test_classification_report_rows(spark):
    rows = [("T", "a", 0, 0.9, 1), ("T", "b", 0, 0.8, 0), ("T", "c", 0, 0.1, 0), ("T", "d", 0, 0.2, 1)]
    df = spark.createDataFrame(rows, "fold string, EID string, PEAKID int, proba double, label int")
    th = spark.createDataFrame([("T", 0.5)], "fold string, threshold double")
    rep = {r["class"]: r for r in classification_report(df, th).collect()}
    assert rep["1"]["precision"] == 0.5 and rep["1"]["recall"] == 0.5 and rep["1"]["support"] == 2
    assert rep["accuracy"]["f1_score"] == 0.5 and rep["accuracy"]["precision"] is None
    assert rep["weighted avg"]["f1_score"] == pytest.approx(0.5)


def test_fold_eligibility_positive_guard(spark):
    # months 2022-01..2022-09; positives per month chosen so folds have 4, 5, 6 train positives
    pos = {"2022-01": 1, "2022-02": 1, "2022-03": 0, "2022-04": 1, "2022-05": 0, "2022-06": 1, "2022-07": 1, "2022-08": 1, "2022-09": 1}
    rows = []
    for m, k in pos.items():
        for i in range(5):
            rows.append((m, f"E{i}", 1 if i < max(k, 1) and k else 0))
        rows.append((m, "X", 1))  # every month has both classes
    df = spark.createDataFrame(rows, "TARGET_MONTH string, EID string, IS_PROFITABLE int")
    el = {r["VAL_MONTH"]: r for r in fold_eligibility(df, min_train_months=6, min_positives=10).collect()}
    assert sorted(el) == ["2022-07", "2022-08", "2022-09"]
    assert [el[m]["n_train_pos"] for m in sorted(el)] == [10, 12, 14]
    assert [el[m]["eligible"] for m in sorted(el)] == [True, True, True]
    el5 = {r["VAL_MONTH"]: r["eligible"] for r in fold_eligibility(df, 6, min_positives=12).collect()}
    assert el5 == {"2022-07": False, "2022-08": True, "2022-09": True}
    fm = fold_map(df).orderBy("fold_id").collect()
    assert [(r["fold_id"], r["VAL_MONTH"], r["TRAIN_LAST"]) for r in fm][0] == (1, "2022-07", "2022-06")


def test_previous_fold_tuning(spark):
    from monthpick.operators.metrics import evaluation_rows

    rows = [("2022-01", "a", 0, 0.9, 1), ("2022-01", "b", 0, 0.1, 0), ("2022-02", "a", 0, 0.2, 1), ("2022-02", "b", 0, 0.1, 0)]
    df = spark.createDataFrame(rows, "fold string, EID string, PEAKID int, proba double, label int")
    same = {r["label"]: r["threshold"] for r in evaluation_rows(df).collect()}
    prev = {r["label"]: r["threshold"] for r in evaluation_rows(df, tune_on="previous_fold").collect()}
    assert prev["2022-01"] == 0.3 and prev["2022-02"] == same["2022-01"]


def test_ranking_metrics_equal_separate(scored):
    from monthpick.operators.metrics import ranking_metrics

    df, _ = scored
    both = {r[0]: (r[1], r[2]) for r in ranking_metrics(df).collect()}
    auc = dict(roc_auc(df).collect())
    ap = dict(average_precision(df).collect())
    assert set(both) == set(auc)
    for f in auc:  # sums of floats: equal up to summation order
        assert both[f][0] == pytest.approx(auc[f], abs=1e-12)
        assert both[f][1] == pytest.approx(ap[f], abs=1e-12)


def test_scan_over_many_parts(spark):
    """A prefix scan whose folds cross and share the parts of the sort, with null folds, NaN and null scores."""
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["A", "A", "A", "B", "C", None]), rng.choice([rng.random(), round(rng.random(), 1), 0.5, float("nan"), None]), int(rng.random() < 0.3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "fold string, proba double, label int").repartition(7)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        groups = _score_groups(df, "fold", "proba", "label").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    order = lambda p: 2 if p is None else 0 if p != p else 1  # noqa: E731  NaN first, null last
    for fold in ("A", "B", "C", None):
        mine = sorted(((order(p), 0 if order(p) != 1 else -p), y) for f, p, y in rows if f == fold)
        got = sorted((((order(r["s"]), 0 if order(r["s"]) != 1 else -r["s"]), r["tp_s"], r["n_ge"]) for r in groups if r["fold"] == fold))
        assert got == [(k, sum(y for q, y in mine if q <= k), sum(q <= k for q, _ in mine)) for k in sorted({q for q, _ in mine})]
