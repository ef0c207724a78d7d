"""Cleaning and tokenising pipeline over ``documents``: five stages, each one operator of ``monthpick.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and
reread as the next stage's ``docs``.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthpick.llm import decontaminate, jaccard_join, private_data, sentencepieces, toxicity
from monthpick.llm.common import Scratch, short_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = "_".join(["toxicity", *docs.columns])  # no column of documents has this name
    return toxicity.score_toxicity(docs, model, tuple(docs.columns), name).where(F.col(name) < toxicity.CUT).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a test item go."""
    return decontaminate.drop_copies(docs, table(spark, sf_dir, "benchmark"))


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in angle brackets; every document stays."""
    return private_data.redact(docs, private_data.find_private_data(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that is left; staged, as the batches' length holds only for a job that runs at once."""
    with short_batches(spark, sentencepieces.TEXTS_AT_ONCE):
        return Scratch(spark, "pieces").stage(sentencepieces.encode(docs, sentencepieces.load_model(), keep=("doc_id", "lang", "source"), check=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("private_data", redact_private_data),
    ("sentencepiece", encode_pieces),
]
#: SQL cannot express a trained classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir))
    return docs
