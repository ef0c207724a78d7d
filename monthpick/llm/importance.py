"""Importance resampling towards a target distribution by hashed n-gram features (operator 12).

Words come from an untrained pre-tokeniser: a Regex split over the text with A-Z lowered
gives words with their offsets.  A feature is a window of 1 to 3 consecutive words, given
by the offset pair of its first and last word; it is the window's words joined by one
space, and its bucket is the CRC of those bytes modulo ``BUCKETS``.  The CRC of a window
continues that of the window one word shorter, so no window is ever built.

One pass over the corpus writes each text's buckets (two bytes a feature) as a table in
the shared folder; the counts of all buckets, the scores and the draw read that table.
Counts are summed inside tasks first, so a task shuffles one row for each bucket at most,
and what reaches the driver and all tasks is ``BUCKETS`` numbers whatever the corpus.

The draw keeps the highest sums of a text's weight and a Gumbel number that follows from
its id.  Ranks are places in a distributed sort: row numbers within its partitions plus
the sizes of the partitions before.

Edge cases: a null or empty text has no words, weight 0 and is never drawn; long texts are
tokenised in pieces cut at separators, with windows across the cuts; rows that repeat a
doc_id are rows of their own (equal scores rank the row with fewer features first, then the
lower weight); a null doc_id is an empty one in the Gumbel number and ranks last among
ties; empty tables give no rows, and an empty target gives every bucket the gain of the
corpus alone; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch, Shipped, blocks

BUCKETS = 10_000
#: Words of a window at most.
WINDOW = 3
#: Texts with fewer words are not drawn.
MIN_WORDS = 20
#: Percent of the texts with enough words that are drawn.
PERCENT = 5
SEED = 42
#: Characters that separate words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Characters of a text that are tokenised at once.
PIECE = 1 << 18
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_ROW = "doc_id bigint, n_words bigint, n_features bigint, buckets binary"


def pre_tokenizer():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(SEPARATOR + "+"), "removed")


def text_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces that end before a separator."""
    at, cut = 0, re.compile(SEPARATOR)
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def feature_buckets(text: str, split) -> tuple[int, np.ndarray]:
    """Number of words and the buckets of all windows of 1 to ``WINDOW`` words, in no order."""
    words, found, last = 0, [], []
    for piece in text_pieces(text.translate(_LOWER)):
        # the spans that end in this piece; ``last`` are the words before it that windows may start with
        spans = [piece[a:b].encode() for _, (a, b) in split(piece)]
        joined = [b" " + w for w in (*last, *spans)]
        codes = [zlib.crc32(w[1:]) for w in joined]
        words += len(spans)
        for n in range(WINDOW):
            if n:  # windows of n + 1 words: those of n words, continued
                codes = list(map(zlib.crc32, joined[n:], codes))
            new = codes[max(len(last) - n, 0) :]  # without windows that end before this piece
            found.append(np.fromiter(new, np.int64, len(new)) % BUCKETS)
        last = [w[1:] for w in joined[-(WINDOW - 1) :]]
    return words, np.concatenate(found).astype(np.uint16)


def with_buckets(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of every text (``uint16`` as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizer().pre_tokenize_str
        for batch in batches:
            for start, end in blocks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                part = batch.slice(start, end - start)
                rows = [feature_buckets(t or "", split) for t in part.column(1).to_pylist()]
                arrays = [part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(b) for _, b in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([b.tobytes() for _, b in rows], pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROW)


def bucket_counts(features: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), np.uint16), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    summed = features.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in summed.collect():  # one row for each bucket at most
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    shipped = Shipped(features.sparkSession, gains)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.load()
        for batch in batches:
            weight = [int(gain[np.frombuffer(b.as_buffer(), np.uint16)].sum()) for b in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with their place, from 1 on, by falling score and rising doc_id."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    placed = scratch.stage(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row for each partition of the sort
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", place).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    ``target`` (text) is the distribution to draw towards.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    features = scratch.stage(with_buckets(docs))
    gains = bucket_gains(bucket_counts(features), bucket_counts(with_buckets(target.select(F.lit(None).alias("doc_id"), "text"))))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.stage(_weights(features, gains).withColumn("score", F.col("weight") + gumbel))
    scratch.drop(features)
    enough = F.col("n_words") >= min_words
    ranked = _ranked(scored.where(enough), scratch)
    drawn = percent * scored.where(enough).count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.withColumn("rank", rank).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))
