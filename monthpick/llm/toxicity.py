"""Toxicity: a convolutional text classifier trained in numpy (operator 5).

A word's embedding is the sum of two rows of a hashed table, one of the word and one
of its first characters (inflected forms share it).  Filters of several widths run
over the whole text, max pooling keeps each filter's strongest answer, and a logistic
layer reads the pooled answers.  Thresholds are calibrated by language on all labelled
rows outside the held-out fold that the training didn't see, each class of a language
weighted to its share of the labelled rows there, so neither the bounds of the training
sample nor its class ratio move them; a histogram of the scores is all that leaves the
executors.  The fit itself is one task's work on the bounded sample; the driver gets the
model alone.  The language is taken from the text's own function
words, never from the lang column, and the score is rescaled so that a language's
threshold lies at 0.7.

Edge cases: null and empty texts have no words and get the score of the bias; very
long texts are scored whole, in blocks of words; repeated rows give repeated results;
without labelled rows of both classes every score is 0; other columns are ignored
except those named by ``keep``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Memo, Shipped, byte_column, held_out, short_batches, text_blocks, tidy

#: Bounds of the labelled sample that the classifier is fitted on, by class.
MAX_TOXIC, MAX_CLEAN = 2_500, 5_000
HASH_BITS, DIM, WIDTHS, FILTERS = 24, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.05, 7
PREFIX_BYTES, MIN_DOCS, VALIDATION, LEAST_VALID = 5, 2, 5, 15
CUT = 0.7
#: Rows of whole texts that the fit and the calibration take at once.
FIT_ROWS = 1_000
#: Bytes of text that are scored at once; the filters' answers take about 50 times as much.
SCORE_BLOCK = 1 << 18
#: Cells of the score histograms, even in the log odds from -SPREAD to SPREAD.
CELLS, SPREAD = 4_096, 16.0
#: Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that for on with as are was by from it this have not be",
    "de": "der die das und ist nicht von zu den mit sich auf für ein eine dem auch wie im werden",
    "fr": "le la les des et est que qui dans pour un une sur pas avec plus ce il elle par",
    "es": "el los las que y en un una por con para del se su como más lo al es pero",
}
_LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def text_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters and digits."""
    if not text.isascii():
        text = text.decode(errors="replace").lower().encode()
    return text.translate(_LETTERS).split()


def word_keys(word: bytes) -> tuple[int, int]:
    """Hashed keys of a word and of its first characters."""
    mask = (1 << HASH_BITS) - 1
    return xxhash.xxh3_64_intdigest(word) & mask, xxhash.xxh3_64_intdigest(word[:PREFIX_BYTES], seed=1) & mask


@dataclass
class Model:
    rows: dict[int, int]  # hashed key -> row of the table; row 0 is every other key
    table: np.ndarray
    filters: np.ndarray  # (sum of widths, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray = field(default_factory=lambda: np.full(len(FUNCTION_WORDS) + 1, CUT))

    def packed(self, word: bytes) -> int:
        a, b = word_keys(word)
        return self.rows.get(a, 0) << 32 | self.rows.get(b, 0)


def _languages(words: list[list[bytes]]) -> np.ndarray:
    """Index of the language with the most function words; the last index where none has any."""
    sets = [frozenset(w.encode() for w in v.split()) for v in FUNCTION_WORDS.values()]
    out = np.full(len(words), len(sets))
    for i, ws in enumerate(words):
        found = set(ws)
        hits = [len(found & s) for s in sets]
        if max(hits):
            out[i] = int(np.argmax(hits))
    return out


def _answers(model: Model, a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every filter's answer at every word (a filter that reaches beyond its text's end sees zeros), and the embeddings."""
    lengths = np.diff(offsets)
    x = model.table[a] + model.table[b]
    left = np.repeat(offsets[1:], lengths) - np.arange(len(x))  # words from here to the text's end
    parts = x @ np.concatenate(list(model.filters), axis=1)
    out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
    k = 0
    for f, w in enumerate(WIDTHS):
        got = parts[:, k * FILTERS : (k + 1) * FILTERS].copy()
        for j in range(1, w):
            inside = left[: max(len(x) - j, 0)] > j
            got[: len(inside)] += parts[j:, (k + j) * FILTERS : (k + j + 1) * FILTERS] * inside[:, None]
        k += w
        out[:, f * FILTERS : (f + 1) * FILTERS] = got
    return out + model.bias, x


def _raw_scores(model: Model, a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores before calibration."""
    pooled = np.zeros((len(offsets) - 1, len(WIDTHS) * FILTERS), np.float32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        answers, _ = _answers(model, a, b, offsets)
        pooled[full] = np.maximum(np.maximum.reduceat(answers, offsets[:-1][full], axis=0), 0)
    return 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -50, 50)))


def _calibrated(model: Model, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Rescale so that the language's threshold lies at CUT; order within a language stays."""
    t = model.cuts[language]
    return np.where(raw < t, raw / t * CUT, CUT + (raw - t) / np.maximum(1 - t, 1e-9) * (1 - CUT))


def _best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """Threshold with the best F1, in the middle of the gap below the last accepted score."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # no cut within ties
    k = int(f1.argmax())
    low = s[k + 1] if k + 1 < len(s) else 0.0
    return float(np.clip((s[k] + low) / 2, 0.02, 0.98))


def _best_cell_cut(toxic: np.ndarray, clean: np.ndarray) -> float:
    """``_best_cut`` of weighted histograms by cell."""
    filled = np.flatnonzero(toxic + clean)[::-1]
    f1 = 2 * np.cumsum(toxic[filled]) / (np.cumsum((toxic + clean)[filled]) + toxic.sum())
    k = int(f1.argmax())
    score = lambda cell: 1 / (1 + np.exp(-(cell / CELLS * 2 - 1) * SPREAD))
    low = score(filled[k + 1] + 1) if k + 1 < len(filled) else 0.0
    return float(np.clip((score(filled[k]) + low) / 2, 0.02, 0.98))


def _calibrate(model: Model, documents: DataFrame, marks: DataFrame, learned: DataFrame) -> None:
    """Set the thresholds from all labelled rows of ``documents``; those ``learned`` from only count for the class shares."""
    shared = Shipped(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.load()
        memo = Memo(model.packed)
        for batch in batches:
            cells, languages = [], []
            for texts in text_blocks(batch, "text", SCORE_BLOCK):
                words = [text_words(t) for t in texts]
                raw = np.clip(_raw_words(model, words, memo), 1e-9, 1 - 1e-9)
                odds = np.log(raw / (1 - raw))
                cells.append(np.clip((odds / SPREAD + 1) / 2 * CELLS, 0, CELLS - 1).astype(np.int32))
                languages.append(_languages(words).astype(np.int32))
            if cells:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(languages)), pa.array(np.concatenate(cells))], names=["doc_id", "language", "cell"])

    source = documents.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", "text")
    cells = source.mapInArrow(tidy(run), source.select("doc_id").schema.add("language", "integer").add("cell", "integer"))
    # documents' texts stay where they are: only small rows meet the labels
    rows = cells.join(marks, "doc_id").join(F.broadcast(learned.withColumn("learned", F.lit(True))), "doc_id", "left")
    counts = rows.groupBy("language", "cell", "toxic", F.col("learned").isNotNull().alias("learned")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # languages x cells x 4 at most
    seen = np.zeros((2, 2, len(model.cuts), CELLS))  # learned, class, language, cell
    at = [counts[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("learned", "toxic", "language", "cell")]
    seen[tuple(at)] = counts["n"].to_numpy()
    free, total = seen[0].sum(2), seen.sum(0).sum(2)  # class, language
    if min(free.sum(1)) > 0:
        whole = seen[0].sum(1) * (total.sum(1) / free.sum(1))[:, None]
        model.cuts[:] = _best_cell_cut(whole[1], whole[0])
        for k in range(len(model.cuts)):
            if min(free[:, k]) >= LEAST_VALID:
                own = seen[0][:, k] * (total[:, k] / free[:, k])[:, None]
                model.cuts[k] = _best_cell_cut(own[1], own[0])


def text_keys(text: bytes, memo: Memo) -> tuple[np.ndarray, int]:
    """What training keeps of a text: the hashed keys of its words, and its language."""
    ws = text_words(text)
    return np.array([memo[w] for w in ws], np.uint32).reshape(-1, 2), int(_languages([ws])[0])


def train(texts: list[bytes], labels: list[int]) -> Model:
    """``train_keys`` on texts."""
    memo = Memo(word_keys, 50_000)
    return train_keys(*zip(*(text_keys(t, memo) for t in texts)), labels)


def train_keys(keys: tuple[np.ndarray, ...], languages: tuple[int, ...], labels: list[int]) -> Model:
    """Fit on labelled texts' keys; every fifth of them only calibrates the thresholds, which ``fit`` sets anew from all rows."""
    rng = np.random.default_rng(SEED)
    y = np.asarray(labels, np.float32)
    n = len(keys)
    learn = np.arange(n) % VALIDATION != 0
    language = [k for k, x in zip(languages, learn) if not x]
    by_class = [np.unique(np.concatenate([np.unique(keys[i]) for i in np.flatnonzero(learn & (y == k))] or [np.zeros(0, np.uint32)]), return_counts=True) for k in (0, 1)]
    kept = np.union1d(by_class[0][0], by_class[1][0])
    counts = np.zeros((len(kept) + 1, 2))  # texts with the key, by class
    for k, (found, times) in enumerate(by_class):
        counts[1 + np.searchsorted(kept, found), k] = times
    often = counts[1:].sum(1) >= MIN_DOCS
    kept, counts = kept[often], counts[np.concatenate([[True], often])]
    rows = {k: r for r, k in enumerate(kept.tolist(), 1)}
    totals = np.array([(learn & (y == 0)).sum(), (learn & (y == 1)).sum()]) + 1.0
    odds = np.log((counts[:, 1] + 0.5) / totals[1]) - np.log((counts[:, 0] + 0.5) / totals[0])
    doubt = 1.64 * np.sqrt((1 / (counts + 0.5)).sum(1))
    table = rng.normal(0, 0.02, (len(kept) + 1, DIM)).astype(np.float32)
    table[:, 0] = np.sign(odds) * np.maximum(np.abs(odds) - doubt, 0) / 4  # a cautious start; training moves it
    table[0] = 0
    filters = rng.normal(0, 0.3, (sum(WIDTHS), DIM, FILTERS)).astype(np.float32)
    filters[:, 0] = np.abs(filters[:, 0]) + 0.3
    width = len(WIDTHS) * FILTERS
    model = Model(rows, table, filters, np.full(width, -0.2, np.float32), np.full(width, 0.3, np.float32), -2.0)
    ids = []
    for k in keys:
        at = np.minimum(np.searchsorted(kept, k), max(len(kept) - 1, 0))
        ids.append(np.where(kept[at] == k, at + 1, 0).astype(np.int32) if len(kept) else np.zeros(k.shape, np.int32))

    def batch(which):
        offsets = np.zeros(len(which) + 1, np.int64)
        np.cumsum([len(ids[i]) for i in which], out=offsets[1:])
        flat = np.concatenate([ids[i] for i in which]) if offsets[-1] else np.zeros((0, 2), np.int32)
        return flat[:, 0], flat[:, 1], offsets

    speed = {"table": np.full(table.shape[0], 1e-6), "filters": np.full(filters.shape, 1e-6), "bias": np.full(width, 1e-6), "out": np.full(width, 1e-6)}
    chosen = np.flatnonzero(learn)
    for _ in range(EPOCHS):
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            which = chosen[at : at + BATCH]
            a, b, offsets = batch(which)
            answers, x = _answers(model, a, b, offsets)
            pooled, where = np.zeros((len(which), width), np.float32), np.zeros((len(which), width), np.int64)
            for i in np.flatnonzero(np.diff(offsets)):
                piece = answers[offsets[i] : offsets[i + 1]]
                where[i] = piece.argmax(0)
                pooled[i] = piece[where[i], np.arange(width)]
                where[i] += offsets[i]
            active = pooled > 0
            pooled = np.where(active, pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -50, 50)))
            err = (p - y[which]) / len(which)
            grad_out = pooled.T @ err
            back = np.where(active, err[:, None] * model.out, 0)  # texts x filters
            grad_filters, k = np.zeros_like(model.filters), 0
            touched, grads = [], []
            for f, w in enumerate(WIDTHS):
                cols = slice(f * FILTERS, (f + 1) * FILTERS)
                i, c = np.nonzero(back[:, cols])
                g, pos = back[:, cols][i, c], where[:, cols][i, c]
                for j in range(w):
                    ok = pos + j < offsets[1:][i]
                    np.add.at(grad_filters[k + j].T, c[ok], x[pos[ok] + j] * g[ok, None])
                    gx = g[ok, None] * model.filters[k + j][:, c[ok]].T
                    touched += [a[pos[ok] + j], b[pos[ok] + j]]
                    grads += [gx, gx]
                k += w
            rows_hit, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(rows_hit), DIM))
            np.add.at(total, inverse, np.concatenate(grads))
            total[rows_hit == 0] = 0
            speed["table"][rows_hit] += (total**2).mean(1)
            model.table[rows_hit] -= (RATE * total / np.sqrt(speed["table"][rows_hit])[:, None]).astype(np.float32)
            for name, grad in (("filters", grad_filters), ("bias", back.sum(0)), ("out", grad_out)):
                speed[name] += grad**2
                value = getattr(model, name)
                value -= (RATE * grad / np.sqrt(speed[name])).astype(np.float32)
            model.out_bias -= RATE * float(err.sum())
    check = np.flatnonzero(~learn)
    raw = np.concatenate([_raw_scores(model, *batch(check[i : i + BATCH])) for i in range(0, len(check), BATCH)])
    language = np.array(language)
    truth = y[check]
    if truth.min() < truth.max():
        model.cuts[:] = _best_cut(raw, truth)
        for k in range(len(model.cuts)):
            own = language == k
            if min((truth[own] == 1).sum(), (truth[own] == 0).sum()) >= LEAST_VALID:
                model.cuts[k] = _best_cut(raw[own], truth[own])
    return model


def score_texts(model: Model | None, texts: list[bytes], memo: Memo | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    words = [text_words(t) for t in texts]
    return _calibrated(model, _raw_words(model, words, memo), _languages(words))


def _raw_words(model: Model, words: list[list[bytes]], memo: Memo) -> np.ndarray:
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    packed = np.fromiter((memo[w] for ws in words for w in ws), np.int64, offsets[-1])
    return _raw_scores(model, packed >> 32, packed & 0xFFFFFFFF, offsets)


def fit(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | None:
    """Fit on at most ``max_toxic`` + ``max_clean`` labelled documents, the ones whose ids hash lowest; calibrate on all others.

    Only rows outside the held-out fold are read.  Documents with contradicting or
    null labels are left out.
    """
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    chosen = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(m) for k, m in ((1, max_toxic), (0, max_clean))]
    # the sample is bounded by the two parameters, so it may be broadcast and fitted on in one task
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").where("text is not null")
    rows = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, memo = [], Memo(word_keys, 50_000)
        for batch in batches:
            for i, (doc, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = byte_column(batch.slice(i, 1), "text")[0]  # one text at a time: only its keys stay
                got.append((xxhash.xxh3_64_intdigest(text), doc, int(y), *text_keys(text, memo)))
        del memo
        if len({row[2] for row in got}) < 2 or len(got) < 2 * VALIDATION:
            return
        got.sort(key=lambda row: row[:2])
        _, ids, labels, keys, languages = zip(*got)
        got.clear()
        model = train_keys(keys, languages, list(labels))
        learned = [i for k, i in enumerate(ids) if k % VALIDATION]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))]), pa.array([learned])], names=["model", "learned"])

    kind = dict(rows.dtypes)["doc_id"]
    with short_batches(documents.sparkSession, FIT_ROWS):
        fitted = rows.repartition(1).mapInArrow(tidy(run), f"model binary, learned array<{kind}>").collect()
    if not fitted:
        return None
    model = Model(**pickle.loads(bytes(fitted[0]["model"])))
    learned = documents.sparkSession.createDataFrame([(i,) for i in fitted[0]["learned"]], sample.select("doc_id").schema)
    with short_batches(documents.sparkSession, FIT_ROWS):
        _calibrate(model, documents, marks, learned)
    return model


def score_toxicity(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """(doc_id, *keep, score under ``name``) for every row: one pass over the whole texts, no shuffle."""
    shared = Shipped(documents.sparkSession, model)  # bounded by the training sample
    columns = ["doc_id", *[c for c in keep if c != "doc_id"]]
    source = documents.select(*columns, *(["text"] if "text" not in columns else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.load()
        memo = Memo(model.packed) if model else None
        for batch in batches:
            scores = [score_texts(model, texts, memo) for texts in text_blocks(batch, "text", SCORE_BLOCK)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in columns], pa.array(scores, pa.float64())], names=[*columns, name])

    schema = source.select(*columns).schema.add(name, "double")
    return source.mapInArrow(tidy(run), schema)
