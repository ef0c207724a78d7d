"""Leakage property, MLlib model properties, SMOTE, sinks round trips."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from monthpick.functions.months import month_range, prev_month
from monthpick.operators.features import feature_matrix
from monthpick.operators.labels import compute_profitability
from monthpick.operators.metrics import roc_auc
from monthpick.operators.models import prepare, score
from monthpick.operators.smote import smote
from monthpick.plans.training import fit_fold
from monthpick.session import scratch_path
from monthpick.sources.sinks import (
    load_bundle,
    read_opportunities_csv,
    read_year_files,
    save_bundle,
    write_opportunities_csv,
)


def test_month_helpers():
    assert prev_month("2022-01") == "2021-12"
    assert month_range("2021-11", "2022-02") == ["2021-11", "2021-12", "2022-01", "2022-02"]


def _world(make, late_value: float):
    """Inputs for target 2022-03 (decision 2022-02) plus rows after the cutoff."""
    rng = random.Random(1)
    sm, sd, pr = [], [], []
    for e in ("A", "B", "C"):
        for sc in (1, 2, 3):
            sm.append((sc, e, "2022-03-05 00:00:00", 0, rng.random(), rng.random() * 100))
            sd.append((sc, e, "2022-02-03 00:00:00", 0, rng.random(), rng.random() * 100))
            # after the daily cutoff of the decision month: must be ignored
            sd.append((sc, e, "2022-02-08 06:00:00", 0, late_value, late_value))
        for m in ("2021-11", "2021-12", "2022-01", "2022-02"):
            pr.append((e, f"{m}-10", 0, rng.random() * 10))
        pr.append((e, "2022-03-10", 0, late_value))  # target month's realized price
    costs = make.costs([(e, "2022-03", 0, late_value) for e in ("A", "B", "C")])
    hist = compute_profitability(make.prices(pr), costs)
    return feature_matrix(make.sim_monthly(sm), make.sim_daily(sd), hist)


def _rounded_rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_changing_rows_after_cutoff_does_not_change_features(make):
    a = _rounded_rows(_world(make, 1.0))
    b = _rounded_rows(_world(make, 1e9))
    assert a == b and len(a) == 3


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(3)
    rows = []
    for m in ("2022-01", "2022-02", "2022-03"):
        for i in range(120):
            y = 1 if rng.random() < 0.25 else 0
            rows.append((m, f"E{i}", i % 2, rng.gauss(2.0 * y, 0.7), rng.gauss(-1.0 * y, 0.7), y))
    return spark.createDataFrame(
        rows, "TARGET_MONTH string, EID string, PEAKID int, f1 double, f2 double, IS_PROFITABLE int"
    )


@pytest.mark.parametrize("model_type", ["logistic", "lightgbm", "xgboost"])
def test_models_score_in_unit_interval_and_separate(spark, separable, model_type):
    feats = ["f1", "f2", "PEAKID"]
    data = prepare(separable, feats)
    n = data.count()
    n_pos = data.where(F.col("label") == 1).count()
    model = fit_fold(data, feats, model_type, n, n_pos, n_trees=5, max_iter=50)
    s = score(model, data).select(
        F.col("TARGET_MONTH").alias("fold"), "proba", F.col("label").cast("int").alias("label")
    )
    stats = s.agg(F.min("proba"), F.max("proba")).first()
    assert 0.0 <= stats[0] <= stats[1] <= 1.0
    assert all(v > 0.7 for _, v in roc_auc(s).collect())
    again = score(fit_fold(data, feats, model_type, n, n_pos, n_trees=5, max_iter=50), data)
    assert sorted(r[0] for r in again.select("proba").collect()) == pytest.approx(
        sorted(r[0] for r in score(model, data).select("proba").collect())
    )


def test_smote_count_and_bounds(spark, separable):
    feats = ["f1", "f2"]
    data = prepare(separable, feats)
    n = data.count()
    n_pos = data.where(F.col("label") == 1).count()
    out, _, _ = smote(data, feats, ["EID", "PEAKID", "TARGET_MONTH"], n, n_pos)
    assert out.count() == 2 * (n - n_pos)
    assert out.where(F.col("label") == 1).count() == n - n_pos
    lo = data.where(F.col("label") == 1).agg(F.min("f1"), F.max("f1"), F.min("f2"), F.max("f2")).first()
    syn = out.where(F.col("label") == 1).agg(F.min("f1"), F.max("f1"), F.min("f2"), F.max("f2")).first()
    assert lo[0] <= syn[0] and syn[1] <= lo[1] and lo[2] <= syn[2] and syn[3] <= lo[3]


def test_bundle_and_csv_round_trip(spark, separable):
    feats = ["f1", "f2"]
    data = prepare(separable, feats)
    model = fit_fold(data, feats, "logistic", data.count(), data.where("label = 1").count(), max_iter=20)
    path = scratch_path(spark, "bundle-test")
    save_bundle(model, path, 0.35, feats, "logistic")
    b = load_bundle(spark, path)
    assert b["threshold"] == 0.35 and b["feat_cols"] == feats and b["model_type"] == "logistic"
    a = sorted(r[0] for r in score(model, data).select("proba").collect())
    c = sorted(r[0] for r in score(b["model"], data).select("proba").collect())
    assert a == pytest.approx(c)
    sel = spark.createDataFrame([("2022-01", "ON", "E1"), ("2022-01", "OFF", "E2")], "TARGET_MONTH string, PEAK_TYPE string, EID string")
    p = scratch_path(spark, "csv-test")
    write_opportunities_csv(sel, p)
    assert sorted(read_opportunities_csv(spark, p).collect()) == sorted(sel.collect())


def test_year_files_by_name(spark):
    base = scratch_path(spark, "years-test")
    for y in (2021, 2022, 2023):
        spark.createDataFrame([(y, i) for i in range(3)], "y int, i int").write.parquet(
            os.path.join(base, f"sim_{y}.parquet")
        )
    got = read_year_files(spark, base, [2022, 2023])
    assert sorted({r[0] for r in got.collect()}) == [2022, 2023]
    assert read_year_files(spark, base, [1999]).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="driver test data absent")
def test_bounded_run_equals_full_run_on_its_months(spark):
    from monthpick.plans.pipelines import run
    from monthpick.sources.adapters import driver_sources

    raw = driver_sources(spark, "/root/testdata/sf0.001")
    part = run(raw, "1997-01", "1997-06")
    full = run(raw).where(F.col("TARGET_MONTH").between("1997-01", "1997-06"))
    a = sorted(tuple(r) for r in part.collect())
    b = sorted(tuple(r) for r in full.collect())
    assert a == b and {r[0] for r in a} == {f"1997-0{i}" for i in range(1, 7)}


@pytest.fixture(scope="module")
def monthly_ds(spark):
    """Labeled-dataset-shaped fixture: 5 months x 60 keys, two features."""
    rng = random.Random(11)
    rows = []
    for m in ("2022-01", "2022-02", "2022-03", "2022-04", "2022-05"):
        for i in range(60):
            y = 1 if rng.random() < 0.3 else 0
            rows.append((f"E{i:02d}", i % 2, m, rng.gauss(1.5 * y, 1.0), rng.gauss(-y, 1.0), y, rng.gauss(10 * y - 3, 1)))
    return spark.createDataFrame(
        rows,
        "EID string, PEAKID int, TARGET_MONTH string, sm_PSM_mean double, sm_ACTIVATIONLEVEL_mean double, "
        "IS_PROFITABLE int, PROFIT double",
    )


def test_walk_forward_folds_and_selections(spark, monthly_ds):
    from monthpick.plans.training import walk_forward

    res = walk_forward(monthly_ds, "logistic", min_train_months=2, max_iter=30)
    folds = {r["label"]: r for r in res.folds.collect()}
    assert sorted(folds) == ["2022-03", "2022-04", "2022-05"]  # months < val train each fold
    for r in folds.values():
        assert 0.05 <= r["threshold"] <= 0.9 or r["threshold"] == 0.5
        assert 0.0 <= r["roc_auc"] <= 1.0 and r["n_positive_true"] > 0
    per_month = dict(res.selections.groupBy("TARGET_MONTH").count().collect())
    assert set(per_month) == set(folds) and all(10 <= n <= 60 for n in per_month.values())
    assert res.model is not None and res.last_train_month == "2022-04"
    assert {r["metric"] for r in res.rollup.collect()} == {"f1", "precision", "recall", "pr_auc"}


def test_compare_models_long_table(spark, monthly_ds):
    from monthpick.plans.training import compare_models

    hist = monthly_ds.select(
        F.regexp_replace("TARGET_MONTH", "-", "").cast("int").alias("MONTH"),
        "EID",
        "PEAKID",
        (F.col("IS_PROFITABLE") == 1).alias("IS_PROFITABLE"),
        "PROFIT",
    )
    long, rollup = compare_models(monthly_ds, hist, min_train_months=3, n_trees=3, max_iter=20)
    got = sorted((r["model"], r["MONTH"]) for r in long.collect())
    assert got == [(m, v) for m in ("lightgbm", "logistic", "xgboost") for v in ("2022-04", "2022-05")]
    assert {r["model"]: r["n_folds"] for r in rollup.collect()} == {"lightgbm": 2, "logistic": 2, "xgboost": 2}


def test_rerun_selection_from_bundle(spark, monthly_ds):
    from monthpick.plans.training import rerun_selection, save_result_bundle, walk_forward

    res = walk_forward(monthly_ds, "logistic", min_train_months=3, max_iter=20)
    path = scratch_path(spark, "bundle-rerun")
    save_result_bundle(res, path)
    sel = rerun_selection(spark, path, monthly_ds.drop("sm_ACTIVATIONLEVEL_mean"), 2)
    months = {r["TARGET_MONTH"]: r["in_sample"] for r in sel.select("TARGET_MONTH", "in_sample").distinct().collect()}
    assert months == {"2022-03": True, "2022-04": True, "2022-05": False}


def test_walk_forward_with_smote(spark, monthly_ds):
    from monthpick.plans.training import walk_forward

    res = walk_forward(monthly_ds, "lightgbm", use_smote=True, min_train_months=3, n_trees=3)
    assert sorted(r["label"] for r in res.folds.collect()) == ["2022-04", "2022-05"]


def test_year_files_strict(spark):
    base = scratch_path(spark, "years-strict")
    spark.createDataFrame([(1,)], "i int").write.parquet(os.path.join(base, "sim_2022.parquet"))
    with pytest.raises(FileNotFoundError):
        read_year_files(spark, base, [1999], strict=True)
    assert read_year_files(spark, base, [2022], strict=True).count() == 1


def test_year_files_and_convert_read_names_of_any_file_system(spark, tmp_path):
    from monthpick.sources.sinks import bulk_convert

    spark.range(3).write.parquet(f"file://{tmp_path}/in/a/x_2020.parquet")
    spark.range(2).write.parquet(f"file://{tmp_path}/in/y.parquet")
    outs = bulk_convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert sorted(o.rsplit("/out/", 1)[1] for o in outs) == ["a/x_2020.csv", "y.csv"]
    assert spark.read.option("header", True).csv(outs).count() == 5
    spark.range(1).write.json(f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        bulk_convert(spark, f"{tmp_path}/none", f"{tmp_path}/out2")


def test_bounded_run_prunes_the_price_scan(spark):
    import os

    from monthpick.plans.pipelines import load_for_targets
    from monthpick.sources.adapters import driver_sources

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("driver test data absent")
    d = load_for_targets(driver_sources(spark, sf), "1996-03", "1996-06", stage="none")
    plan = d.prices._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "1996-06-01" in plan
    assert d.hist.agg(F.max("MONTH")).first()[0] <= 199605


def test_history_queries_do_not_read_the_daily_sims(spark):
    import os

    from monthpick.plans.context import inputs

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("driver test data absent")
    i = inputs(spark, sf)
    assert i.hist.count() > 0 and set(i._staged) == {"hist"}


def test_invalid_fits_have_a_status_and_other_failures_end_the_comparison(spark, monthly_ds, monkeypatch):
    from monthpick.plans import training

    def broken(train, feat_cols, model_type, *a, **k):
        raise ValueError("bad parameter") if model_type == "lightgbm" else RuntimeError("lost executor")

    real = training.fit_fold
    hist = spark.createDataFrame([], "EID string, MONTH int, PEAKID int, PR double, C double, PROFIT double, IS_PROFITABLE boolean")
    monkeypatch.setattr(training, "fit_fold", lambda t, f, m, *a, **k: broken(t, f, m) if m == "lightgbm" else real(t, f, m, *a, **k))
    long, rollup = training.compare_models(monthly_ds, hist, ("logistic", "lightgbm"), min_train_months=3)
    status = {(r.model, r.status.split(":")[0]) for r in long.collect()}
    assert status == {("logistic", "fitted"), ("lightgbm", "not fitted")}
    monkeypatch.setattr(training, "fit_fold", broken)
    with pytest.raises(RuntimeError):
        training.compare_models(monthly_ds, hist, ("logistic",), min_train_months=3)


def test_model_queries_train_all_boosting_rounds(spark, monkeypatch):
    import inspect
    from types import SimpleNamespace

    from monthpick.operators.models import GBT_TREES
    from monthpick.plans import q_ml

    rounds = {}

    def seen(what, work, result):
        def call(*args, **kwargs):
            bound = inspect.signature(work).bind(*args, **kwargs)
            bound.apply_defaults()
            rounds[what] = bound.arguments["n_trees"]
            return result

        monkeypatch.setattr(q_ml, what, call)

    seen("walk_forward", q_ml.walk_forward, None)
    seen("compare_models", q_ml.compare_models, None)
    monkeypatch.setattr(q_ml, "_dataset", lambda *a, **k: (None, SimpleNamespace(hist=None)))
    monkeypatch.setattr(q_ml, "_DONE", {})
    q_ml._walk(spark, "d", "lightgbm")
    q_ml._comparison(spark, "d")
    assert rounds == {"walk_forward": GBT_TREES, "compare_models": GBT_TREES} and GBT_TREES == 500


def test_neighbour_recall_against_brute_force(spark, monkeypatch):
    import numpy as np

    from monthpick.operators import smote as sm

    monkeypatch.setattr(sm, "QUERY_BLOCK", 7)
    rng = random.Random(9)
    points = [(float(rng.randrange(12)), float(rng.randrange(12)), rng.choice([0.0, 0.5])) for _ in range(300)] + [(3.0, 3.0, 0.0)] * 40
    rows = spark.createDataFrame([(f"q{i}", *p) for i, p in enumerate(points)], "id string, f1 double, f2 double, f3 double").repartition(6)
    asked = F.substring("id", 2, 9).cast("int") % 5 == 0
    got = {r["qid"]: r for r in sm.neighbour_recall(rows, ["f1", "f2", "f3"], asked, F.col("id")).collect()}
    assert set(got) == {f"q{i}" for i in range(0, 340, 5)}
    x = np.array(points)
    for i in range(0, 340, 5):
        d = np.sort(np.delete(np.sqrt(((x - x[i]) ** 2).sum(1)), i))[:5]
        assert got[f"q{i}"]["distances"] == pytest.approx(list(d))
        assert got[f"q{i}"]["hits"] == 5  # one cell: the forest is exact
    few = sm.neighbour_recall(rows.where("id IN ('q1', 'q2', 'q5')"), ["f1", "f2", "f3"], asked, F.col("id")).collect()
    assert [(r["qid"], len(r["distances"]), r["hits"]) for r in few] == [("q5", 2, 2)]
