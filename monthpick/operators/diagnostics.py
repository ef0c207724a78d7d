"""Feature diagnostics: zero-variance columns and highly correlated pairs.

* variance screen — one aggregation (``var_samp`` of every feature, partial
  aggregation), unpivoted with ``stack``.
* correlation pairs — MLlib ``Correlation.corr`` over an assembled feature
  vector: one ``treeAggregate`` of the Gram matrix, instead of hundreds of
  ``corr`` aggregate columns (which exceed the codegen field limit and run
  interpreted).  Only the k×k matrix (k = number of features, a bounded
  summary) reaches the driver.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthpick.session import materialize

CORR_LIMIT = 0.95


def _stack_pairs(wide: DataFrame, labels: list[tuple[str, ...]], cols: list[str], names: list[str]) -> DataFrame:
    parts = []
    for lab, c in zip(labels, cols):
        parts.extend(f"'{x}'" for x in lab)
        parts.append(f"`{c}`")
    return wide.selectExpr(f"stack({len(cols)}, {', '.join(parts)}) AS ({', '.join(names)})")


def variance_screen(df: DataFrame, feat_cols: list[str]) -> DataFrame:
    """Features whose sample variance is exactly 0 (constant columns)."""
    wide = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(feat_cols)])
    long = _stack_pairs(wide, [(c,) for c in feat_cols], [f"v{i}" for i in range(len(feat_cols))], ["feature", "variance"])
    return long.where(F.col("variance") == 0).select("feature")


def correlation_matrix(df: DataFrame, feat_cols: list[str]):
    """Pearson correlation matrix (k×k, driver-side summary)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    # MLlib goes over its input twice: a stage keeps the joins before it from running again
    staged = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in feat_cols]), name="correlation")
    vec = VectorAssembler(inputCols=feat_cols, outputCol="__features", handleInvalid="keep").transform(staged)
    return Correlation.corr(vec, "__features", "pearson").head()[0]


def correlation_pairs(df: DataFrame, feat_cols: list[str], limit: float = CORR_LIMIT) -> DataFrame:
    """Feature pairs with |Pearson correlation| > ``limit`` (NaN never passes)."""
    m = correlation_matrix(df, feat_cols)
    idx = {c: i for i, c in enumerate(feat_cols)}
    rows = []
    for a, b in combinations(feat_cols, 2):
        v = float(m[idx[a], idx[b]])
        if not math.isnan(v) and abs(v) > limit:
            rows.append((a, b, abs(v)))
    schema = T.StructType(
        [
            T.StructField("feature_a", T.StringType()),
            T.StructField("feature_b", T.StringType()),
            T.StructField("abs_corr", T.DoubleType()),
        ]
    )
    return df.sparkSession.createDataFrame(rows, schema)
