"""Incremental build of the labeled dataset: only target months whose inputs changed are built again.

A target month's rows follow from a few months of each input: the monthly sims
of the month, the daily sims of the month before up to their cutoff, the prices
and costs of the months in its history window, and those of its own month.
``target_digests`` folds digests of exactly these rows into one for each target
(calendar-bounded; one grouped pass over each input, map-side sums, no row
leaves its task).  ``refresh_dataset`` compares them with the digests of the last
build, aggregates and joins only what the differing targets need, and replaces
their partitions alone (dynamic partition overwrite, committed by the writer as
a whole).  Partitions of other months keep their files.

The digests of a build are written after its data, as a new version beside it
that is complete or not there at all.  A build that breaks off in between leaves
the old digests, so the next one builds the same months again.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthpick.functions.months import add_months_int, col_add_months, col_daily_cutoff_ok, month_int_to_str, month_start
from monthpick.operators.dataset import labeled_dataset
from monthpick.operators.features import hist_month_map, sim_daily_features, sim_monthly_features
from monthpick.operators.labels import compute_profitability
from monthpick.schema import DEFAULT_LOOKBACK
from monthpick.session import materialize, materialize_all

#: Digests beside the dataset; readers of the dataset skip names that begin with an underscore.
STATE = "_digests"
#: Part of every digest: another number builds everything again.
FORMAT = 2
_PIECE = (1 << 21) - 1


@dataclass
class Refresh:
    built: list[str]  # target months built again
    dropped: list[str]  # target months that are no more
    kept: int  # target months left as they were


def _keyed(df: DataFrame) -> DataFrame:
    return df.where("EID IS NOT NULL AND PEAKID IS NOT NULL AND MONTH IS NOT NULL")


def _month_digest(df: DataFrame, name: str) -> DataFrame:
    """MONTH and a digest of its rows: in any order, repeated rows told apart."""
    cols = sorted(c for c in df.columns if c != "MONTH")
    row = lambda salt: F.xxhash64(*[F.col(c) for c in cols], F.lit(salt))
    # sums of a hash's pieces of at most 22 bits: plain longs that 2^41 rows of a month don't overflow
    pieces = lambda h: (F.shiftright(h, 42), F.shiftrightunsigned(h, 21).bitwiseAND(_PIECE), h.bitwiseAND(_PIECE))
    hashed = _keyed(df).select("MONTH", row(1).alias("a"), row(2).alias("b"))
    sums = hashed.groupBy("MONTH").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"{c}{k}") for c in "ab" for k, x in enumerate(pieces(F.col(c)))])
    return sums.select("MONTH", F.concat_ws(":", *[F.col(c).cast("string") for c in sums.columns[1:]]).alias(name))


def target_digests(prices: DataFrame, costs: DataFrame, sim_monthly: DataFrame, sim_daily: DataFrame, lookback: int = DEFAULT_LOOKBACK) -> tuple[DataFrame, DataFrame]:
    """(TARGET, digest) of all rows that a target's follow from, and (TARGET, MONTH): its window."""
    early = sim_daily.where(col_daily_cutoff_ok("DATETIME"))
    sm, sd, p, c = materialize_all(
        _month_digest(sim_monthly, "sm"), _month_digest(early, "sd"), _month_digest(prices, "p"), _month_digest(costs, "c"),
        names=[f"digest-{n}" for n in ("sm", "sd", "prices", "costs")],
    )
    labels = p.join(c, "MONTH", "full_outer").select("MONTH", F.concat_ws("/", F.coalesce("p", F.lit("-")), F.coalesce("c", F.lit("-"))).alias("d"))
    targets = sm.withColumnRenamed("MONTH", "TARGET")
    windows = materialize(hist_month_map(labels, targets.select("TARGET"), lookback), name="windows")
    window = windows.join(labels, "MONTH").groupBy("TARGET").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", F.col("MONTH").cast("string"), "d")))).alias("window"))
    daily = sd.select(col_add_months("MONTH", 1).alias("TARGET"), "sd")
    out = targets.join(daily, "TARGET", "left").join(window, "TARGET", "left").join(labels.select(F.col("MONTH").alias("TARGET"), "d"), "TARGET", "left")
    parts = [F.coalesce(x, F.lit("-")) for x in ("sm", "sd", "window", "d")]
    return materialize(out.select("TARGET", F.sha2(F.concat_ws("|", F.lit(f"{FORMAT} {lookback}"), *parts), 256).alias("digest")), name="digests"), windows


def _of_months(df: DataFrame, months: list[int]) -> DataFrame:
    """Rows of some months; where there is a DATETIME its bounds reach the scan."""
    out = df.where(F.col("MONTH").isin(months))
    if "DATETIME" in df.columns and months:
        lo, hi = month_start(min(months)), month_start(add_months_int(max(months), 1))
        out = out.where((F.col("DATETIME") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("DATETIME") < F.lit(hi).cast("timestamp_ntz")))
    return out


def _versions(spark: SparkSession, path: str):
    """File system, and complete versions of the digests in order."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(os.path.join(path, STATE))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return fs, sorted(int(n[1:]) for n in found if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))


def refresh_dataset(
    spark: SparkSession, path: str, prices: DataFrame, costs: DataFrame, sim_monthly: DataFrame, sim_daily: DataFrame, lookback: int = DEFAULT_LOOKBACK
) -> Refresh:
    """Bring the labeled dataset at ``path`` (by TARGET_MONTH) up to date with its inputs (as the loaders give them)."""
    state = lambda v: os.path.join(path, STATE, f"v{v}")
    fs, versions = _versions(spark, path)
    now, windows = target_digests(prices, costs, sim_monthly, sim_daily, lookback)
    old = spark.read.parquet(state(versions[-1])) if versions else spark.createDataFrame([], now.schema)
    # a row for each target month
    both = now.join(old.withColumnRenamed("digest", "before"), "TARGET", "full_outer").orderBy("TARGET").collect()
    build = [r["TARGET"] for r in both if r["digest"] is not None and r["digest"] != r["before"]]
    gone = [r["TARGET"] for r in both if r["digest"] is None]
    if build:
        window = [r[0] for r in windows.where(F.col("TARGET").isin(build)).select("MONTH").distinct().collect()]
        months = sorted({*window, *build})
        sm, sd, labels = materialize_all(
            sim_monthly_features(_of_months(sim_monthly, build)),
            sim_daily_features(_of_months(sim_daily, [add_months_int(t, -1) for t in build])),
            compute_profitability(_of_months(prices, months), _of_months(costs, months)),
            names=["refresh-sm", "refresh-sd", "refresh-labels"],
        )
        # the months of the windows alone give the same windows
        ds = labeled_dataset(sim_monthly, sim_daily, labels.where(F.col("MONTH").isin(window)), lookback, sm_features=sm, sd_features=sd, truth=labels)
        ds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("TARGET_MONTH").parquet(path)
    jvm = spark._jvm
    for t in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"TARGET_MONTH={month_int_to_str(t)}"), True)
    if build or gone or not versions:
        now.coalesce(1).write.mode("overwrite").parquet(state((versions or [0])[-1] + 1))
        for v in versions[:-1]:  # the version before stays for readers of it
            fs.delete(jvm.org.apache.hadoop.fs.Path(state(v)), True)
    return Refresh([month_int_to_str(t) for t in build], [month_int_to_str(t) for t in gone], len(both) - len(build) - len(gone))
