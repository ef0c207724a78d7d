"""Hand-built micro tables for the semantics ledger (labels, features, selection)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from monthpick.operators.features import feature_matrix, hist_month_map, sim_daily_features, sim_monthly_features
from monthpick.operators.labels import compute_profitability
from monthpick.operators.selection import composite_score, select_from_scores, select_opportunities, topk_with_floor


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ------------------------------------------------------------------ labels


def test_full_outer_join_zero_fill_and_profit_sign(make):
    prices = make.prices(
        [
            ("A", "2022-01-03", 0, 10.0),  # price and cost
            ("A", "2022-01-04", 0, 5.0),
            ("B", "2022-01-05", 1, 7.0),  # price only
            ("D", "2022-01-06", 0, 3.0),  # profit exactly 0
            (None, "2022-01-06", 0, 99.0),  # null EID dropped
            ("A", "2022-01-07", 0, float("nan")),  # NaN skipped
        ]
    )
    costs = make.costs([("A", "2022-01", 0, 4.0), ("C", "2022-01", 1, 2.0), ("D", "2022-01", 0, 3.0)])
    h = compute_profitability(prices, costs)
    got = rows(h, "EID", "MONTH", "PEAKID", "PR", "C", "PROFIT", "IS_PROFITABLE")
    assert got == [
        ("A", 202201, 0, 15.0, 4.0, 11.0, True),
        ("B", 202201, 1, 7.0, 0.0, 7.0, True),
        ("C", 202201, 1, 0.0, 2.0, -2.0, False),
        ("D", 202201, 0, 3.0, 3.0, 0.0, False),
    ]


def test_duplicate_cost_key_fans_out(make):
    prices = make.prices([("A", "2022-01-03", 0, 10.0)])
    costs = make.costs([("A", "2022-01", 0, 4.0), ("A", "2022-01", 0, 1.0)])
    assert compute_profitability(prices, costs).count() == 2


# ---------------------------------------------------------------- features


def test_history_window_uses_present_months_and_absent_decision(make, spark):
    # label months present: 2021-07..2021-10 and 2021-12 (11 missing), 2022-02
    months = ["2021-07", "2021-08", "2021-09", "2021-10", "2021-12", "2022-02"]
    prices = make.prices([("A", f"{m}-05", 0, 1.0) for m in months])
    costs = make.costs([])
    hist = compute_profitability(prices, costs)
    targets = spark.createDataFrame([(202201,), (202203,), (202302,)], "TARGET int")
    mm = hist_month_map(hist, targets, lookback=3)
    got = {}
    for t, m in mm.collect():
        got.setdefault(t, []).append(m)
    # target 2022-01: decision 2021-12 present -> 12, 10, 09 (11 is absent)
    assert sorted(got[202201]) == [202109, 202110, 202112]
    # target 2022-03: decision 2022-02 -> 02, 12, 10
    assert sorted(got[202203]) == [202110, 202112, 202202]
    # target 2023-02: decision 2023-01 absent -> last present months before it
    assert sorted(got[202302]) == [202110, 202112, 202202]


def test_history_never_reaches_target_month(make, spark):
    prices = make.prices([("A", "2022-01-05", 0, 100.0), ("A", "2021-12-05", 0, 1.0)])
    hist = compute_profitability(prices, make.costs([]))
    targets = spark.createDataFrame([(202201,)], "TARGET int")
    assert [r[1] for r in hist_month_map(hist, targets).collect()] == [202112]
    prior = hist_month_map(hist, targets, hist_through="prior_month").collect()
    assert prior == []


def test_daily_cutoff_inclusive_day8_midnight(make):
    sd = make.sim_daily(
        [
            (1, "A", "2022-03-07 23:00:00", 0, 1.0, 10.0),
            (1, "A", "2022-03-08 00:00:00", 0, 1.0, 20.0),
            (1, "A", "2022-03-08 01:00:00", 0, 1.0, 1000.0),  # after cutoff
            (1, "A", "2022-04-01 00:00:00", 0, 1.0, 5000.0),  # next month, own decision
        ]
    )
    f = sim_daily_features(sd)
    got = {r["TARGET"]: r["sd_PSD_mean"] for r in f.collect()}
    assert got[202204] == pytest.approx(15.0)  # decision March -> target April
    assert got[202205] == pytest.approx(5000.0)


def test_january_target_uses_december_decision(make):
    sd = make.sim_daily([(1, "A", "2021-12-02 00:00:00", 0, 1.0, 7.0)])
    f = sim_daily_features(sd).collect()
    assert [(r["TARGET"], r["sd_PSD_mean"]) for r in f] == [(202201, 7.0)]


def test_scenario_std_population(make):
    sm = make.sim_monthly(
        [
            (1, "ONE", "2022-05-01", 0, 1.0, 10.0),  # single scenario -> 0
            (1, "EQ", "2022-05-01", 0, 1.0, 5.0),
            (2, "EQ", "2022-05-01", 0, 1.0, 5.0),
            (3, "EQ", "2022-05-01", 0, 1.0, 5.0),
            (1, "UNEQ", "2022-05-01", 0, 1.0, 0.0),  # scenario means 1, 4, 10
            (1, "UNEQ", "2022-05-02", 0, 1.0, 2.0),
            (2, "UNEQ", "2022-05-01", 0, 1.0, 4.0),
            (3, "UNEQ", "2022-05-01", 0, 1.0, 10.0),
        ]
    )
    f = {r["EID"]: r for r in sim_monthly_features(sm).collect()}
    assert f["ONE"]["sm_PSM_scenario_std"] == 0.0
    assert f["EQ"]["sm_PSM_scenario_std"] == 0.0
    import statistics

    assert f["UNEQ"]["sm_PSM_scenario_std"] == pytest.approx(statistics.pstdev([1.0, 4.0, 10.0]))
    assert f["UNEQ"]["sm_PSM_mean"] == pytest.approx(4.0)  # row mean, not mean of scenario means


# --------------------------------------------------------------- selection


def _pool(spark, month, n, score_fn, eid_fmt="E{:03d}"):
    return spark.createDataFrame(
        [(month, eid_fmt.format(i), i % 2, float(score_fn(i))) for i in range(n)],
        "TARGET_MONTH string, EID string, PEAKID int, score double",
    )


def test_topk_floor_branches(spark):
    def above(k, n=200):
        return lambda i: 0.9 if i < k else 0.1

    cases = {"2022-01": (9, 200), "2022-02": (10, 200), "2022-03": (100, 200), "2022-04": (101, 200)}
    df = None
    for m, (k, n) in cases.items():
        p = _pool(spark, m, n, above(k))
        df = p if df is None else df.unionByName(p)
    seven = _pool(spark, "2022-05", 7, lambda i: 0.9)
    df = df.unionByName(seven)
    picked = topk_with_floor(df, "score", 0.5, k=50, floor=10)
    counts = dict(picked.groupBy("TARGET_MONTH").count().collect())
    assert counts == {"2022-01": 10, "2022-02": 10, "2022-03": 50, "2022-04": 50, "2022-05": 7}
    model = select_from_scores(df.withColumnRenamed("score", "proba"), 0.5)
    counts = dict(model.groupBy("TARGET_MONTH").count().collect())
    assert counts == {"2022-01": 10, "2022-02": 10, "2022-03": 100, "2022-04": 100, "2022-05": 7}


def test_ties_broken_by_keys(spark):
    df = spark.createDataFrame(
        [("2022-01", f"E{i:02d}", p, 0.5) for i in range(8) for p in (0, 1)],
        "TARGET_MONTH string, EID string, PEAKID int, score double",
    )
    picked = topk_with_floor(df, "score", 0.0, k=10, floor=10).orderBy("rank").collect()
    assert [(r["EID"], r["PEAKID"]) for r in picked][:4] == [("E00", 0), ("E00", 1), ("E01", 0), ("E01", 1)]


def _matrix(spark, rows):
    cols = (
        "TARGET_MONTH string, EID string, PEAKID int, sm_PSM_mean double, sm_ACTIVATIONLEVEL_mean double, "
        "hist_profit_rate_6m double, hist_mean_profit_6m double, sm_PSM_scenario_std double"
    )
    return spark.createDataFrame(rows, cols)


def test_minmax_constant_column_and_negative_profit_clip(spark):
    m = _matrix(
        spark,
        [
            ("2022-01", "A", 0, 10.0, 1.0, 0.5, -50.0, 1.0),
            ("2022-01", "B", 0, 20.0, 1.0, 0.5, -10.0, 3.0),
            ("2022-01", "C", 0, 30.0, 1.0, 0.5, 20.0, 2.0),
        ],
    )
    s = {r["EID"]: r["score"] for r in composite_score(m).collect()}
    # psm: 0, .5, 1 ; activation constant -> .5 ; rate constant -> .5 ;
    # profit clipped: 0, 0, 20 -> 0, 0, 1 ; agreement (-std): -1,-3,-2 -> 1, 0, .5
    exp = {
        "A": 0.35 * 0 + 0.25 * 0.5 + 0.2 * 0.5 + 0.15 * 0 + 0.05 * 1,
        "B": 0.35 * 0.5 + 0.25 * 0.5 + 0.2 * 0.5 + 0.15 * 0 + 0.05 * 0,
        "C": 0.35 * 1 + 0.25 * 0.5 + 0.2 * 0.5 + 0.15 * 1 + 0.05 * 0.5,
    }
    for k, v in exp.items():
        assert s[k] == pytest.approx(v, abs=1e-9)


def test_selection_output_is_distinct_and_bounded(spark):
    rows_ = [("2022-01", f"E{i:03d}", i % 2, float(i), 1.0, 0.1, 1.0, 1.0) for i in range(300)]
    sel = select_opportunities(_matrix(spark, rows_), target_k=500)
    assert sel.count() == 100  # K clamped to 100
    assert sel.distinct().count() == 100
    sel = select_opportunities(_matrix(spark, rows_), target_k=1)
    assert sel.count() == 10


def test_feature_matrix_candidates_are_monthly_sim_keys(make):
    sm = make.sim_monthly([(1, "A", "2022-02-10", 0, 2.0, 10.0)])
    sd = make.sim_daily([(1, "B", "2022-01-02", 0, 1.0, 1.0)])  # not a candidate
    hist = compute_profitability(make.prices([("A", "2022-01-05", 0, 3.0)]), make.costs([]))
    m = feature_matrix(sm, sd, hist).collect()
    assert [(r["EID"], r["TARGET_MONTH"]) for r in m] == [("A", "2022-02")]
    r = m[0]
    assert r["sd_PSD_mean"] == 0.0 and r["hist_months_active_6m"] == 1 and r["hist_mean_pr_6m"] == 3.0


def test_selection_invariant_to_partitioning(spark):
    rows_ = [("2022-01", f"E{i:03d}", i % 2, float(i % 37), float(i % 11), 0.1, 1.0, 1.0) for i in range(400)]
    m = _matrix(spark, rows_)
    a = rows(select_opportunities(m), "TARGET_MONTH", "PEAK_TYPE", "EID")
    b = rows(select_opportunities(m.repartition(7).orderBy(F.rand(3))), "TARGET_MONTH", "PEAK_TYPE", "EID")
    assert a == b


def test_results_do_not_depend_on_session_time_zone(spark, make):
    def world():
        sd = make.sim_daily(
            [
                (1, "A", "2022-03-08 00:00:00", 0, 1.0, 20.0),
                (1, "A", "2022-03-08 01:00:00", 0, 1.0, 1000.0),
                (1, "A", "2022-03-31 23:00:00", 0, 1.0, 7.0),
            ]
        )
        from monthpick.functions.predicates import apply_filters

        kept = apply_filters(sd, [("DATETIME", ">=", "2022-03-01"), ("DATETIME", "<", "2022-04-01")])
        return sorted(tuple(r) for r in sim_daily_features(kept).collect()), kept.count()

    utc = world()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert world() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc[1] == 3


def test_unlabeled_months_and_cost_duplicates(make, spark):
    from monthpick.operators.dataset import attach_labels
    from monthpick.operators.labels import cost_duplicates

    costs = make.costs([("A", "2022-01", 0, 4.0), ("A", "2022-01", 0, 1.0), ("B", "2022-01", 0, 1.0)])
    assert [tuple(r) for r in cost_duplicates(costs).collect()] == [("A", 202201, 0, 2)]
    hist = compute_profitability(make.prices([("A", "2022-01-03", 0, 10.0)]), costs)
    m = spark.createDataFrame(
        [("A", 0, "2022-01"), ("A", 0, "2022-02")], "EID string, PEAKID int, TARGET_MONTH string"
    )
    kept = attach_labels(m, hist).collect()
    assert sorted((r["TARGET_MONTH"], r["IS_PROFITABLE"]) for r in kept) == [
        ("2022-01", 1), ("2022-01", 1), ("2022-02", 0)  # duplicate cost key fans out; no label -> 0
    ]
    dropped = attach_labels(m, hist, drop_unlabeled=True).collect()
    assert {r["TARGET_MONTH"] for r in dropped} == {"2022-01"}


def test_smote_tiny_minority(spark):
    from monthpick.operators.smote import smote

    rows = [("E%d" % i, 0, "2022-01", float(i), float(-i), 1.0 if i < 2 else 0.0) for i in range(8)]
    df = spark.createDataFrame(rows, "EID string, PEAKID int, TARGET_MONTH string, f1 double, f2 double, label double")
    out, _, _ = smote(df, ["f1", "f2"], ["EID", "PEAKID", "TARGET_MONTH"], 8, 2)  # k = min(5, 2 - 1) = 1
    assert out.count() == 12 and out.where("label = 1").count() == 6
    one, _, _ = smote(df.where("EID != 'E1'"), ["f1", "f2"], ["EID", "PEAKID", "TARGET_MONTH"], 7, 1)
    assert one.count() == 7  # a single positive has no neighbour: no synthetic rows


def test_smote_many_identical_minority_rows(spark):
    from monthpick.operators.smote import smote

    rows = [("D%d" % i, 0, "2022-01", 0.0, 0.0, 1.0) for i in range(40)]  # 40 identical positives
    rows += [("P%d" % i, 0, "2022-01", 5.0 + i, 1.0, 1.0) for i in range(3)]
    rows += [("N%d" % i, 0, "2022-01", float(i), float(i), 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "EID string, PEAKID int, TARGET_MONTH string, f1 double, f2 double, label double")
    out, _, _ = smote(df, ["f1", "f2"], ["EID", "PEAKID", "TARGET_MONTH"], 143, 43)
    syn = out.where("label = 1")
    assert out.count() == 200 and syn.count() == 100
    # copies of the repeated vector have their copies as neighbours: their synthetics stay at (0, 0)
    assert syn.where("f1 = 0.0 AND f2 = 0.0").count() >= 40 + 40


def _vectors(kind: str, n: int, d: int):
    import numpy as np

    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d))
    if kind == "sparse":
        x = np.where(rng.random((n, d)) < 0.08, x, 0.0)
        x = np.unique(x, axis=0)
    if kind == "core":
        x[: n // 4] = 1 + x[: n // 4] * 1e-4
        x[-5:] *= 1e6
    return x


@pytest.mark.parametrize("kind,n,d", [("normal", 500, 6), ("normal", 2000, 22), ("normal", 8000, 6), ("normal", 8000, 22), ("sparse", 2000, 6), ("core", 4000, 6)])
def test_smote_neighbours_are_the_nearest(spark, kind, n, d):
    """At least nine tenths of the true five nearest, at every size and shape; no vector is left alone."""
    import numpy as np

    from monthpick.operators.smote import nearest

    x = _vectors(kind, n, d)
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(x.tolist())], ["pid", *names])
    got = {}
    for r in nearest(df, names, 5).collect():
        got.setdefault(r.pid, set()).add(r.npid)
    assert len(got) == len(x) and all(len(v) == 5 for v in got.values())
    asked = np.random.default_rng(0).choice(len(x), 200, replace=False)
    hits = 0
    for i in asked:
        dist = ((x - x[i]) ** 2).sum(1)
        dist[i] = np.inf
        limit = np.partition(dist, 4)[4]
        hits += sum(dist[j] <= limit for j in got[i])
    assert hits >= 0.9 * 5 * len(asked)


def test_smote_cells_do_not_grow(spark):
    """Vectors compared with each vector: bounded by the cell, not by the number of rows."""
    import monthpick.operators.smote as sm

    for n in (3000, 12_000):
        df = spark.range(n).select(F.col("id").alias("pid"), F.lit(0).alias("tree"), F.lit(0).cast("bigint").alias("cell"), F.array(F.randn(1), F.randn(2)).alias("x"))
        level = 0
        while df.groupBy("cell").count().agg(F.max("count")).first()[0] > sm.CELL:
            df = sm.materialize(sm._cut(df, level, 1))
            level += 1
        sizes = [r[0] for r in df.groupBy("cell").count().select("count").collect()]
        assert max(sizes) <= sm.CELL and sum(sizes) == n


def test_smote_oversamples_whichever_class_is_smaller(spark):
    from monthpick.operators.smote import smote

    rows = [(f"E{i}", i % 2, "2020-01", float(i), float(i % 7), 0.0 if i < 8 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, ["EID", "PEAKID", "TARGET_MONTH", "f1", "f2", "label"])
    out, n, pos = smote(df, ["f1", "f2"], ["EID", "PEAKID", "TARGET_MONTH"], 40, 32)
    assert (n, pos) == (64, 32) and out.count() == 64 and out.where("label = 0").count() == 32
    same, n, pos = smote(df, ["f1", "f2"], ["EID", "PEAKID", "TARGET_MONTH"], 40, 32, only_positive=True)
    assert (n, pos) == (40, 32) and same.count() == 40


def test_nan_scores_fail_and_nan_features_are_zero(spark):
    from monthpick.operators.dataset import fill_missing_features
    from monthpick.operators.selection import topk_with_floor

    nan = float("nan")
    df = spark.createDataFrame([("m", f"E{i:02d}", 0, nan if i == 0 else i / 100) for i in range(30)], ["TARGET_MONTH", "EID", "PEAKID", "proba"])
    picked = topk_with_floor(df, "proba", 0.05, 100, 10).collect()
    assert len(picked) == 25 and all(r.EID != "E00" for r in picked)
    got = fill_missing_features(spark.createDataFrame([(nan, None)], "a double, b double"), ["a", "b", "c"]).first()
    assert tuple(got) == (0.0, 0.0, 0.0)


def test_month_filters_meet_text_and_int_months(spark):
    from monthpick.sources.loaders import load_costs, year_ranges

    raw = spark.createDataFrame([("E1", f"2020-{m:02d}", 0, float(m)) for m in range(1, 7)], "EID string, MONTH string, PEAKID int, C double")
    assert sorted(r.MONTH for r in load_costs(raw, filters=[("MONTH", ">=", "2020-03"), ("MONTH", "in", ["2020-02", "2020-05"])]).collect()) == [202005]
    ints = raw.withColumn("MONTH", F.regexp_replace("MONTH", "-", "").cast("int"))
    assert load_costs(ints, filters=[("MONTH", "<", "2020-03")]).count() == 2
    assert [(a.year, b.year) for a, b in year_ranges([2022, 2019, 2020])] == [(2019, 2021), (2022, 2023)]


def test_snap_keeps_large_values(spark):
    from monthpick.functions.columns import snap

    df = spark.createDataFrame([(5.0e15,), (1.5,), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(snap("x", 6)).collect()] == [5.0e15, 1.5, float("inf"), None]


def test_crowded_scores_spread_over_parts(spark):
    """Scores of a rare class crowd near 0; no part of the sort behind the running sums holds more than a few percent of them."""
    from monthpick.operators.metrics import ranking_metrics

    n = 40_000
    df = spark.range(n).select(F.lit("f").alias("fold"), (1 / (1 + F.exp(12 + F.randn(3)))).alias("proba"), (F.rand(4) < 0.1).cast("int").alias("label"))
    df = df.cache()
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["count"] for r in df.orderBy("fold", F.col("proba").desc()).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 0.03 * n
        assert abs(ranking_metrics(df).first()["roc_auc"] - 0.5) < 0.02
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lookback_names_the_model_features():
    from monthpick.schema import available_features, matrix_feature_names

    got = available_features([*matrix_feature_names(3), "PEAKID"])
    assert len(got) == 22 and "hist_profit_rate_3m" in got and not any(c.endswith("_6m") for c in got)


def test_float32_dataset(spark, tmp_path):
    from monthpick.sources.sinks import read_dataset, write_dataset

    df = spark.createDataFrame([("2020-01", 1.1, 3)], "TARGET_MONTH string, a double, n int")
    write_dataset(df, str(tmp_path / "ds"), float32=True)
    got = read_dataset(spark, str(tmp_path / "ds"))
    assert dict(got.dtypes)["a"] == "float" and got.first()["n"] == 3
