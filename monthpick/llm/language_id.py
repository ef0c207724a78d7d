"""Language identification: averaged hashed subword embeddings and a linear softmax (operator 8).

Subwords are byte n-grams inside words (with a word-boundary mark), hashed to a fixed
number of buckets.  A text's vector is the average of its subwords' embeddings; a
linear softmax reads it.  Both layers are trained by stochastic gradient descent in
numpy.  A temperature fitted on rows that the training didn't see calibrates the
probabilities, and the rejection threshold is the lowest confidence that keeps the
wanted precision on those rows.

Edge cases: a null text or one without a letter gets ``und`` and score 0 (rejected);
a model without any labelled text answers ``und`` everywhere; very long texts are read
whole, in blocks; repeated rows give repeated results; of ties the first language in
alphabetical order wins; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Shipped, blocks, byte_column, held_out

#: Bound of the labelled sample that the classifier is fitted on.
MAX_SAMPLE = 3_000
BUCKET_BITS, DIM, GRAMS = 16, 16, (2, 3, 4)
EPOCHS, BATCH, RATE, SEED, VALIDATION, PRECISION = 4, 32, 0.2, 11, 5, 0.99
UNKNOWN = "und"
#: Letters stay (lower-cased A-Z); everything else of ASCII is a word boundary.
_FOLD = np.frombuffer(bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256)).lower(), np.uint8)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (buckets, languages): embedding times output layer, as the layers are linear
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of folded bytes and the position of each.  An n-gram has a boundary at its ends only."""
    ids, at = [], []
    letter = data != 32
    wide = data.astype(np.uint32)
    for n in GRAMS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        code = np.full(size, n, np.uint32)
        inside = np.ones(size, bool)
        for j in range(n):
            code = code * np.uint32(0x01000193) ^ wide[j : j + size]
            if 0 < j < n - 1:
                inside &= letter[j : j + size]
        if n == 2:
            inside &= letter[:size] | letter[1 : size + 1]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        pos = np.flatnonzero(inside)
        ids.append((code[pos] >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
        at.append(pos)
    return (np.concatenate(ids), np.concatenate(at)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def fold(text: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(map(str.isalpha, set(text.decode(errors="ignore"))))


def text_logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean subword logits of each text."""
    parts = [fold(t) for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    ids, at = subwords(np.concatenate(parts))
    owner = np.searchsorted(ends, at, side="right")
    n = len(texts)
    counts = np.maximum(np.bincount(owner, minlength=n), 1)
    out = np.stack([np.bincount(owner, model.logits[:, k][ids], minlength=n) for k in range(len(model.languages))], axis=1)
    return out / counts[:, None] + model.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[bytes], languages: list[str]) -> Model:
    rng = np.random.default_rng(SEED)
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    bags = []
    for t in texts:
        ids, counts = np.unique(subwords(fold(t))[0], return_counts=True)
        bags.append((ids, (counts / max(counts.sum(), 1)).astype(np.float32)))
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    learn = np.flatnonzero(np.arange(len(texts)) % VALIDATION != 0)
    steps, step = EPOCHS * -(-len(learn) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            which = learn[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = np.stack([bags[i][1] @ table[bags[i][0]] for i in which])
            err = _softmax(hidden @ out + bias)
            err[np.arange(len(which)), y[which]] -= 1
            back = err @ out.T
            out -= rate * hidden.T @ err / len(which)
            bias -= rate * err.mean(0)
            for i, g in zip(which, back):
                # normalised step: the text's average moves by rate * g, however many subwords share it
                w = bags[i][1]
                table[bags[i][0]] -= rate * (w / max(float(w @ w), 1e-9))[:, None] * g if len(w) else 0
    model = Model(names, table @ out, bias, 1.0, 0.0)
    check = [i for i in range(len(texts)) if i % VALIDATION == 0]
    z, truth = text_logits(model, [texts[i] for i in check]), y[check]

    def loss(t):
        return -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()

    model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    p = _softmax(z / model.temperature)
    score, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-score, kind="stable")
    fine = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    model.reject_below = float(score[order][fine[-1]]) if len(fine) else 1.0
    return model


def fit(documents: DataFrame, max_sample: int = MAX_SAMPLE) -> Model | None:
    """Fit on the ``max_sample`` documents outside the held-out fold whose ids hash lowest."""
    usable = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    got = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x"))
    got = got.select("doc_id", "x.lang", "x.text").toArrow()
    if not got.num_rows:
        return None
    texts, langs = [t.encode() for t in got["text"].to_pylist()], got["lang"].to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (xxhash.xxh3_64_intdigest(texts[i]), langs[i]))
    return train([texts[i] for i in order], [langs[i] for i in order])


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row: one pass over the whole texts, no shuffle."""
    shared = Shipped(documents.sparkSession, model)  # fixed size: buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.load()
        for batch in batches:
            texts = byte_column(batch, "text")
            best, score = [], []
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                some = texts[a:b]
                p = _softmax(text_logits(model, some) / model.temperature) if model else np.zeros((b - a, 1))
                known = [bool(model) and has_letter(t) for t in some]
                best += [model.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1).tolist(), known)]
                score += np.where(known, p.max(1), 0.0).tolist()
            cut = model.reject_below if model else 1.0
            rejected = [x == UNKNOWN or s < cut for x, s in zip(best, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    source = documents.select("doc_id", "text")
    return source.mapInArrow(run, source.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
