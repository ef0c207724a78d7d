"""Sinks and file helpers: dataset Parquet, opportunities CSV, model bundles,
year-file discovery and bulk Parquet -> CSV conversion.

All writes go through the DataFrame writer (executors write their own
partitions); nothing is gathered on the driver.
"""

from __future__ import annotations

import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthpick.operators.models import MODEL_ROW, model_from_row


# ----------------------------------------------------------------- datasets


def write_dataset(
    df: DataFrame, path: str, partition_by: str | None = "TARGET_MONTH", float32: bool = False
) -> None:
    """Feature dataset as Parquet, partitioned by target month (month pruning on
    read).  ``float32`` downcasts double columns at the sink only."""
    if float32:
        df = df.select(*[F.col(n).cast("float").alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "TARGET_MONTH" in df.columns:  # partition value: keep 'YYYY-MM' a string
        df = df.withColumn("TARGET_MONTH", F.col("TARGET_MONTH").cast("string"))
    return df


def write_opportunities_csv(df: DataFrame, path: str) -> None:
    """Header + (TARGET_MONTH, PEAK_TYPE, EID), comma-separated."""
    df.select("TARGET_MONTH", "PEAK_TYPE", "EID").write.mode("overwrite").option("header", True).csv(path)


def read_opportunities_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "TARGET_MONTH string, PEAK_TYPE string, EID string"
    return spark.read.option("header", True).schema(schema).csv(path)


# ------------------------------------------------------------ model bundles


def save_bundle(
    model, path: str, threshold: float, feat_cols: list[str], model_type: str, last_train_month: str | None = None
) -> None:
    """The model and its metadata as one-row Parquet tables (no pickle)."""
    spark = SparkSession.getActiveSession()
    row = model.to_row()
    values = tuple([bytearray(a) for a in row[c]] if c == "arrays" else row[c] for c in ("kind", "feat_cols", "start", "edges", "depth", "arrays"))
    spark.createDataFrame([values], MODEL_ROW).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "model"))
    meta = spark.createDataFrame(
        [(float(threshold), json.dumps(list(feat_cols)), model_type, last_train_month)],
        "threshold double, feat_cols string, model_type string, last_train_month string",
    )
    meta.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))


def load_bundle(spark: SparkSession, path: str) -> dict:
    meta = spark.read.parquet(os.path.join(path, "meta")).first()
    return {
        "model": model_from_row(spark.read.parquet(os.path.join(path, "model")).first().asDict()),
        "threshold": float(meta["threshold"]),
        "feat_cols": json.loads(meta["feat_cols"]),
        "model_type": meta["model_type"],
        "last_train_month": meta["last_train_month"] if "last_train_month" in meta else None,
    }


# ------------------------------------------------------------ file helpers


def read_year_files(spark: SparkSession, folder: str, years=None, strict: bool = False) -> DataFrame:
    """Per-year Parquet files of a folder, restricted to ``years`` by file name.

    The year comes from each row's ``_metadata.file_path``; with ``years`` the
    filter is on that metadata column (file pruning, no rows of other years
    are decoded).  No match gives an empty result rather than every file;
    ``strict=True`` raises instead (listing only, no data is read).
    """
    if strict and years and not year_files(spark, folder, years):
        raise FileNotFoundError(f"no per-year file for {sorted(years)} in {folder}")
    df = spark.read.parquet(os.path.join(folder, "*.parquet"))
    # first stand-alone 4-digit group after the folder: the dataset (file or
    # directory) name, never a part-file counter
    anchor = re.escape(os.path.basename(os.path.normpath(folder)))
    pattern = anchor + r"/.*?(?<![0-9])([0-9]{4})(?![0-9])"
    df = df.withColumn("__year", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int"))
    if years:
        df = df.where(F.col("__year").isin([int(y) for y in years]))
    return df.drop("__year")


def _datasets(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the ``*.parquet`` files and folders below ``folder``, of any file system Spark reads.

    A folder with that name is one dataset: what lies inside is not listed.  Names only; no data is read.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out, open_ = [], [root]
    while open_:
        for status in fs.listStatus(open_.pop()):
            path = status.getPath()
            if path.getName().endswith(".parquet"):
                out.append(path.toString())
            elif status.isDirectory() and not path.getName().startswith(("_", ".")):
                open_.append(path)
    return sorted(out)


def year_files(spark: SparkSession, folder: str, years=None) -> list[str]:
    """Listing helper: per-year datasets of a folder (first 4-digit group of the name)."""
    ys = None if years is None else {str(int(y)) for y in years}
    out = []
    for f in _datasets(spark, folder):
        m = re.search(r"(?<![0-9])([0-9]{4})(?![0-9])", f.rsplit("/", 1)[-1])
        if ys is None or (m and m.group(1) in ys):
            out.append(f)
    return out


def bulk_convert(spark: SparkSession, input_folder: str, output_folder: str, parallelism: int = 4) -> list[str]:
    """Every Parquet dataset below ``input_folder`` -> a CSV directory (header,
    comma) at the same relative path under ``output_folder``.  Keeping the
    relative path avoids two inputs with the same base name overwriting each
    other.  Each conversion is a distributed read + write, some at a time; a
    folder without any dataset raises."""
    found = _datasets(spark, input_folder)
    if not found:
        raise FileNotFoundError(f"no Parquet dataset below {input_folder}")
    base = spark._jvm.org.apache.hadoop.fs.Path(input_folder)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"

    def convert(path: str) -> str:
        out = os.path.join(output_folder, path.removeprefix(base).removesuffix(".parquet") + ".csv")
        spark.read.parquet(path).write.mode("overwrite").option("header", True).csv(out)
        return out

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(convert, found))
