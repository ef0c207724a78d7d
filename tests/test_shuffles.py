"""Rows of the labeled dataset are shuffled once: plans, and the same results as the plain forms."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from monthpick.operators import features
from monthpick.operators.dataset import attach_labels, labeled_dataset
from monthpick.operators.features import feature_matrix, sim_daily_features, sim_monthly_features
from monthpick.operators.labels import compute_profitability
from monthpick.session import materialize


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


SIMS = [
    (1, "A", "2022-03-05", 0, 2.0, 10.0),
    (1, "A", "2022-03-06", 0, 4.0, 30.0),
    (2, "A", "2022-03-05", 0, None, 50.0),
    (3, "A", "2022-03-05", 0, 1.0, None),  # a scenario without price
    (None, "A", "2022-03-05", 0, 1.0, 8.0),  # counts for the mean alone
    (None, "B", "2022-03-05", 1, 1.0, 8.0),
    (2, "C", "2022-02-01", 0, 1.0, float("nan")),
    (7, "C", "2022-03-01", 0, 1.0, 3.0),
]


def test_simulations_are_shuffled_once(make):
    for df in (sim_monthly_features(make.sim_monthly(SIMS)), sim_daily_features(make.sim_daily(SIMS))):
        assert physical(df).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("rows", [SIMS, [(None, *r[1:]) for r in SIMS]])
def test_scenarios_as_columns_and_as_rows_agree(make, monkeypatch, rows):
    few = rounded(sim_monthly_features(make.sim_monthly(rows)))
    monkeypatch.setattr(features, "SCENARIO_COLUMNS", 0)
    if any(r[0] is not None for r in rows):
        assert physical(sim_monthly_features(make.sim_monthly(rows))).count("Exchange hashpartitioning") == 2
    assert few == rounded(sim_monthly_features(make.sim_monthly(rows))) and len(few) == 4


def test_scenario_std_by_hand(make):
    by_key = {(r["TARGET"], r["EID"]): r for r in sim_monthly_features(make.sim_monthly(SIMS)).collect()}
    a = by_key[202203, "A"]
    assert (a["sm_PSM_mean"], a["sm_PSM_scenario_std"], a["sm_ACTIVATIONLEVEL_mean"]) == (24.5, 15.0, 2.0)  # means of scenarios: 20 and 50
    assert by_key[202203, "B"]["sm_PSM_scenario_std"] is None and by_key[202203, "C"]["sm_PSM_scenario_std"] == 0.0
    assert by_key[202202, "C"]["sm_PSM_mean"] is None


def _world(make, spark):
    months = ["2022-01", "2022-02", "2022-03"]
    sm = make.sim_monthly([(s, e, f"{m}-03", p, 1.0 + s, 5.0 * s) for m in months for e in "ABC" for p in (0, 1) for s in (1, 2)])
    sd = make.sim_daily([(s, e, f"{m}-03", p, 1.0 + s, 2.0 * s) for m in months for e in "AB" for p in (0, 1) for s in (1, 2)])
    prices = make.prices([(e, f"{m}-05", 0, 7.0 + k) for m in months[:2] for k, e in enumerate("AB")])
    # A's costs repeat, D has no simulation, a key and a month are null
    costs = make.costs([("A", "2022-01", 0, 4.0), ("A", "2022-01", 0, 20.0), ("A", "2022-02", 0, 1.0), ("C", "2022-02", 1, 3.0), ("D", "2022-02", 0, 1.0), (None, "2022-02", 0, 1.0), ("B", None, 0, 2.0)])
    return sm, sd, materialize(compute_profitability(prices, costs))


@pytest.mark.parametrize("drop", [False, True])
def test_dataset_has_the_rows_of_the_join(make, spark, drop):
    sm, sd, hist = _world(make, spark)
    ds = labeled_dataset(sm, sd, hist, 2, drop_unlabeled=drop)
    plain = attach_labels(feature_matrix(sm, sd, hist, 2, keep_target_int=True), hist, drop).drop("TARGET")
    assert ds.dtypes == plain.dtypes and rounded(ds) == rounded(plain)
    assert ds.where((F.col("EID") == "A") & (F.col("PEAKID") == 0) & (F.col("TARGET_MONTH") == "2022-01")).count() == 2
    later = hist.where("MONTH = 202203")
    assert rounded(labeled_dataset(sm, sd, hist, 2, truth=later)) == rounded(attach_labels(feature_matrix(sm, sd, hist, 2, keep_target_int=True), later).drop("TARGET"))


def test_dataset_rows_go_through_one_shuffle(make, spark):
    sm, sd, hist = _world(make, spark)
    sm, sd = (materialize(f) for f in (sim_monthly_features(sm), sim_daily_features(sd)))
    plan = physical(labeled_dataset(None, None, hist, 2, sm_features=sm, sd_features=sd))
    assert len(re.findall(r"Exchange hashpartitioning\(EID#|Exchange hashpartitioning\(TARGET#\d+, EID#", plan)) == 1 and "SortMergeJoin" not in plan


def test_logistic_walk_stages_its_rows_once(spark, monkeypatch):
    from monthpick.plans import training
    from monthpick.schema import model_features

    names, staged = model_features()[:3], []
    rows = [(f"E{i}", i % 2, f"2022-{m:02d}", *(float((i * (k + 3) + m) % 11) for k in range(3)), int((i * 7 + m) % 3 == 0), 1.0) for m in range(1, 10) for i in range(40)]
    ds = spark.createDataFrame(rows, f"EID string, PEAKID int, TARGET_MONTH string, {', '.join(f'{c} double' for c in names)}, IS_PROFITABLE int, PROFIT double")
    plain = training.fit_together

    def note(df, *a, name="stage", **k):
        staged.append(name)
        return materialize(df, *a, name=name, **k)

    monkeypatch.setattr(training, "materialize", note)
    lean = training.walk_forward(ds, "logistic", min_train_months=3)
    assert "training-rows" not in staged and staged.count("dataset") == 1
    monkeypatch.setattr(training, "fit_together", lambda fits, data, staged=False: plain(fits, data))
    copied = training.walk_forward(ds, "logistic", min_train_months=3)
    assert "training-rows" in staged
    assert rounded(lean.scored) == rounded(copied.scored) and rounded(lean.selections) == rounded(copied.selections)
