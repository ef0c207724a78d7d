"""Command line: ``python -m monthpick <command> [options]``.

Commands mirror the reference's scripts; the four domain tables are read from
Parquet paths (files or folders, e.g. one file per year).

  run       selections for every target month in [--start-month, --end-month] -> CSV
  backtest  monthly precision / recall / F1 / net profit and the summary
  train     walk-forward training of one model; selections -> CSV, bundle saved
  compare   logistic / boosted-tree profiles on the same folds
  rerun     rescore a saved bundle on a written feature dataset -> CSV
  refresh   bring a written feature dataset up to date: only changed target months
  convert   every Parquet file below a folder -> CSV
"""

from __future__ import annotations

import argparse
import sys


def _raw(spark, a):
    from monthpick.sources.adapters import RawSources

    return RawSources(
        prices=spark.read.parquet(a.prices),
        costs=spark.read.parquet(a.costs),
        sim_monthly=spark.read.parquet(a.sim_monthly),
        sim_daily=spark.read.parquet(a.sim_daily),
    )


def _dataset(spark, a):
    from monthpick.operators.dataset import labeled_dataset
    from monthpick.plans.pipelines import load_for_targets

    d = load_for_targets(_raw(spark, a), a.start_month, a.end_month, truth=True)
    return labeled_dataset(d.sim_monthly, d.sim_daily, d.hist, a.lookback, sm_features=d.sm_features, sd_features=d.sd_features), d


def _report(table, folder: str | None) -> None:
    """The whole table as CSV, if a folder is named; else its first rows on the screen."""
    if folder:
        table.write.mode("overwrite").option("header", True).csv(folder)
    else:
        table.show(truncate=False)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="monthpick")
    p.add_argument("--master", default=None, help="e.g. local[8]; spark-submit sets it otherwise")
    sub = p.add_subparsers(dest="cmd", required=True)

    def tables(sp, months=True):
        sp.add_argument("--prices", required=True)
        sp.add_argument("--costs", required=True)
        sp.add_argument("--sim-monthly", required=True)
        sp.add_argument("--sim-daily", required=True)
        if months:
            sp.add_argument("--start-month")
            sp.add_argument("--end-month")

    r = sub.add_parser("run")
    tables(r)
    r.add_argument("--target-k", type=int, default=50)
    r.add_argument("--lookback", type=int, default=6)
    r.add_argument("--hist-through", default="decision_month", choices=["decision_month", "prior_month"])
    r.add_argument("--output", default="opportunities.csv")
    b = sub.add_parser("backtest")
    tables(b)
    b.add_argument("--target-k", type=int, default=50)
    b.add_argument("--lookback", type=int, default=6)
    b.add_argument("--report", default=None, help="folder for the table of months (CSV)")
    t = sub.add_parser("train")
    tables(t)
    t.add_argument("--model", default="lightgbm", choices=["logistic", "lightgbm", "xgboost"])
    t.add_argument("--smote", action="store_true")
    t.add_argument("--weight-with-smote", action="store_true", help="keep the positive weight besides SMOTE")
    t.add_argument("--lookback", type=int, default=6)
    t.add_argument("--dataset-out", default=None, help="write the feature dataset, which rerun reads")
    t.add_argument("--report", default=None, help="folder for the table of folds (CSV)")
    t.add_argument("--min-train-months", type=int, default=6)
    t.add_argument("--output", default="opportunities.csv")
    t.add_argument("--bundle", default=None)
    c = sub.add_parser("compare")
    tables(c)
    c.add_argument("--min-train-months", type=int, default=6)
    c.add_argument("--lookback", type=int, default=6)
    c.add_argument("--report", default=None, help="folder for the table of models and months (CSV)")
    rr = sub.add_parser("rerun")
    rr.add_argument("--bundle", required=True)
    rr.add_argument("--dataset", required=True)
    rr.add_argument("--min-train-months", type=int, default=6)
    rr.add_argument("--output", default="opportunities.csv")
    rf = sub.add_parser("refresh")
    tables(rf, months=False)
    rf.add_argument("--dataset", required=True)
    rf.add_argument("--lookback", type=int, default=6)
    cv = sub.add_parser("convert")
    cv.add_argument("--input", required=True)
    cv.add_argument("--output", required=True)
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from monthpick.session import checkpoint_dir

    builder = SparkSession.builder.appName(f"monthpick-{a.cmd}")
    if a.master:
        builder = builder.master(a.master).config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)

    if a.cmd == "run":
        from monthpick.plans.pipelines import run
        from monthpick.sources.sinks import write_opportunities_csv

        sel = run(_raw(spark, a), a.start_month, a.end_month, a.target_k, a.lookback, hist_through=a.hist_through)
        write_opportunities_csv(sel, a.output)
        from monthpick.operators.evaluation import selections_per_month_describe

        selections_per_month_describe(spark.read.option("header", True).csv(a.output)).show()
    elif a.cmd == "backtest":
        from monthpick.plans.pipelines import run_backtest

        res = run_backtest(_raw(spark, a), a.start_month, a.end_month, a.target_k, a.lookback)
        res.base_rates.show()
        _report(res.monthly.orderBy("MONTH"), a.report)
        res.summary.show()
    elif a.cmd == "train":
        from monthpick.plans.training import save_result_bundle, walk_forward
        from monthpick.sources.sinks import read_dataset, write_dataset, write_opportunities_csv

        ds, _ = _dataset(spark, a)
        if a.dataset_out:
            write_dataset(ds, a.dataset_out)
            ds = read_dataset(spark, a.dataset_out)
        res = walk_forward(ds, a.model, a.smote, a.min_train_months, weight_with_smote=a.weight_with_smote)
        _report(res.folds.orderBy("label"), a.report)
        res.rollup.show()
        write_opportunities_csv(res.selections, a.output)
        if a.bundle:
            save_result_bundle(res, a.bundle)
    elif a.cmd == "compare":
        from monthpick.plans.training import compare_models

        ds, d = _dataset(spark, a)
        long, rollup = compare_models(ds, d.hist, min_train_months=a.min_train_months)
        _report(long.orderBy("model", "MONTH"), a.report)
        rollup.show()
    elif a.cmd == "rerun":
        from monthpick.plans.training import rerun_selection
        from monthpick.sources.sinks import read_dataset, write_opportunities_csv

        sel = rerun_selection(spark, a.bundle, read_dataset(spark, a.dataset), a.min_train_months)
        write_opportunities_csv(sel, a.output)
    elif a.cmd == "refresh":
        from monthpick.plans.refresh import refresh_dataset
        from monthpick.sources.loaders import load_costs, load_prices, load_sim_daily, load_sim_monthly

        raw = _raw(spark, a)
        done = refresh_dataset(
            spark, a.dataset, load_prices(raw.prices), load_costs(raw.costs), load_sim_monthly(raw.sim_monthly), load_sim_daily(raw.sim_daily), a.lookback
        )
        print(f"built {len(done.built)}, dropped {len(done.dropped)}, kept {done.kept} target months")
    elif a.cmd == "convert":
        from monthpick.sources.sinks import bulk_convert

        for out in bulk_convert(spark, a.input, a.output):
            print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
