"""Incremental dataset: what is built again, what keeps its files, and equality with the full build."""

from __future__ import annotations

import glob
import os
import random

import pytest

from monthpick.operators.dataset import labeled_dataset
from monthpick.operators.labels import compute_profitability
from monthpick.plans.refresh import STATE, _month_digest, refresh_dataset
from monthpick.session import scratch_path
from monthpick.sources.sinks import read_dataset


def world(make, price=1.0, daily=1.0, late=1.0, cost=1.0, months=range(1, 10)):
    """Nine months of 2022; ``price`` is a price of March, ``cost`` a cost of June, ``daily`` a daily sim of April before its cutoff, ``late`` one after it."""
    rng = random.Random(5)
    sm, sd, pr, co = [], [], [], []
    for m in months:
        for e in ("A", "B"):
            x = rng.random()
            sm.append((1, e, f"2022-{m:02d}-05 00:00:00", 0, x, 10 * x))
            sd.append((1, e, f"2022-{m:02d}-03 00:00:00", 0, daily if m == 4 else x, x))
            sd.append((1, e, f"2022-{m:02d}-20 00:00:00", 0, late if m == 4 else x, x))
            pr.append((e, f"2022-{m:02d}-10", 0, price if m == 3 else 10 * x))
            co.append((e, f"2022-{m:02d}", 0, cost if m == 6 else 2.0))
    return make.prices(pr), make.costs(co), make.sim_monthly(sm), make.sim_daily(sd)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def full(w, lookback):
    prices, costs, sim_monthly, sim_daily = w
    return rows(labeled_dataset(sim_monthly, sim_daily, compute_profitability(prices, costs), lookback))


def files(path):
    out = {}
    for f in glob.glob(os.path.join(path, "TARGET_MONTH=*", "*.parquet")):
        out.setdefault(os.path.basename(os.path.dirname(f)).split("=")[1], set()).add(os.path.basename(f))
    return out


MONTHS = [f"2022-{m:02d}" for m in range(1, 10)]


@pytest.mark.parametrize(
    "change, built",
    [
        ({"price": 9.0}, ["2022-03", "2022-04", "2022-05"]),  # its own labels, and the windows of two months that hold March
        ({"cost": 9.0}, ["2022-06", "2022-07", "2022-08"]),
        ({"daily": 9.0}, ["2022-05"]),
        ({"late": 9.0}, []),  # after the cutoff: no target follows from it
        ({}, []),
        ({"months": range(1, 8)}, []),  # two months less
        ({"months": range(1, 11)}, ["2022-10"]),
    ],
)
def test_only_what_follows_from_a_change_is_built(spark, make, change, built):
    path = scratch_path(spark, "refresh-test")
    first = refresh_dataset(spark, path, *world(make), lookback=2)
    assert (first.built, first.dropped, first.kept) == (MONTHS, [], 0)
    assert rows(read_dataset(spark, path)) == full(world(make), 2)
    before = files(path)
    done = refresh_dataset(spark, path, *world(make, **change), lookback=2)
    assert done.built == built
    assert done.dropped == (["2022-08", "2022-09"] if change.get("months") == range(1, 8) else [])
    assert rows(read_dataset(spark, path)) == full(world(make, **change), 2)
    after = files(path)
    kept = [m for m in MONTHS if m not in built and m not in done.dropped]
    assert done.kept == len(kept) and all(after[m] == before[m] for m in kept)
    assert all(after[m] != before.get(m) for m in built) and not set(done.dropped) & set(after)


def test_a_build_that_breaks_off_is_done_again(spark, make, monkeypatch):
    path = scratch_path(spark, "refresh-broken")
    refresh_dataset(spark, path, *world(make), lookback=2)
    done = refresh_dataset(spark, path, *world(make, price=9.0), lookback=2)
    # digests of the last build without their mark of completeness
    os.remove(os.path.join(path, STATE, "v2", "_SUCCESS"))
    again = refresh_dataset(spark, path, *world(make, price=9.0), lookback=2)
    assert again.built == done.built and rows(read_dataset(spark, path)) == full(world(make, price=9.0), 2)
    assert refresh_dataset(spark, path, *world(make, price=9.0), lookback=2).built == []
    # another lookback is another dataset
    assert refresh_dataset(spark, path, *world(make, price=9.0), lookback=3).built == MONTHS


def test_digests_add_up_plain_longs(spark, make):
    prices = make.prices([("A", "2022-01-10", 0, 1.0), ("A", "2022-01-10", 0, 1.0), ("B", "2022-01-11", 0, 2.0), ("A", "2022-02-10", 0, 1.0)])
    found = _month_digest(prices, "d")
    assert "decimal" not in found._jdf.queryExecution().toString().lower()  # sums of objects, not of machine words
    # any order gives the same digest; a row less or a row twice another one
    same = _month_digest(prices.orderBy("EID").repartition(3), "d")
    digests = {r["MONTH"]: r["d"] for r in found.collect()}
    assert {r["MONTH"]: r["d"] for r in same.collect()} == digests
    fewer = {r["MONTH"]: r["d"] for r in _month_digest(prices.dropDuplicates(), "d").collect()}
    assert len(digests) == 2 and len(set(digests.values()) | set(fewer.values())) == 3


def test_the_query_joins_the_costs_view_once(spark, monkeypatch):
    from monthpick.plans import q_io

    seen = []
    monkeypatch.setattr(q_io, "refresh_dataset", lambda spark, path, prices, costs, *sims: seen.append(costs))
    monkeypatch.setattr(q_io, "read_dataset", lambda spark, path: seen[-1])
    q_io.q_dataset_refresh(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and all("Join" not in c._jdf.queryExecution().optimizedPlan().toString() for c in seen)


def test_rescoring_reads_the_dataset_that_training_staged(spark, monkeypatch):
    from types import SimpleNamespace

    from monthpick.plans import q_ml

    staged, asked = object(), []
    monkeypatch.setattr(q_ml, "_walk", lambda *a: SimpleNamespace(dataset=staged))
    monkeypatch.setattr(q_ml, "_dataset", lambda *a, **k: pytest.fail("the dataset is built again"))
    monkeypatch.setattr(q_ml, "save_result_bundle", lambda *a: None)
    monkeypatch.setattr(q_ml, "rerun_selection", lambda spark, path, ds, n: asked.append((ds, n)))
    q_ml.q_rerun_selection(spark, "/root/testdata/sf0.001")
    assert asked == [(staged, 6)]
