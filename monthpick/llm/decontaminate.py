"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment (operator 7).

Words are lower-cased runs of letters and digits.  Frequencies of the test items' words
over all documents tell how much information an n-gram of an item carries; the
informative ones (and of every item the most informative few) are its seeds.  A seed
found in a document joins that place to the item, places on neighbouring diagonals make
one region, and a local alignment of item and region scores it, so edited or
paraphrased copies count by what is left of them.  A copy of a part of an item counts
by its own strength, whatever the item's length: a second alignment, in which changed
words cost more than matched ones bring, has to reach that of a run of RUN matched words.

Test items are taken in blocks of a bounded number, and each block meets all documents;
only a block is sent to the executors.

Edge cases: null or empty documents match nothing; items that are null or have fewer
than three words have no seed and match nothing; repeated items and documents each get
their rows; of equally good alignments of a pair the first is kept; an empty table on
either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Shipped, blocks, byte_column, text_blocks, tidy
from monthpick.llm.toxicity import text_words

SEED = 3
#: Bits (by corpus frequencies of its words) from which on an n-gram is a seed, and seeds of an item at least.
MIN_BITS, LEAST_SEEDS = 24.0, 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the item's best possible score from which on a passage counts as a copy.
MIN_SCORE = 0.4
#: Matched words (each changed or missing one costs STRICT of score) from which on a part of an item counts as a copy.
RUN, STRICT = 13, -3
ITEMS_AT_ONCE = 20_000
CELLS = 200_000
SCHEMA = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint, n_matched bigint"


@dataclass
class Index:
    """One block of test items; word 0 is every word that no item has."""

    item_ids: list
    items: list[np.ndarray]
    words: dict[bytes, int]
    seeds: np.ndarray  # packed n-grams, sorted; one entry for each place in an item
    places: np.ndarray  # (item, position) of each


def _pack(ids: np.ndarray) -> np.ndarray:
    """Exact code of each run of SEED word ids; 0 where one is unknown."""
    size = max(len(ids) - SEED + 1, 0)
    wide = ids.astype(np.int64)
    code, known = np.zeros(size, np.int64), np.ones(size, bool)
    for j in range(SEED):
        part = wide[j : j + size]
        code = code << 21 | part
        known &= part > 0
    return np.where(known, code, 0)


def _word_ids(texts: list[bytes], words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    parts = [text_words(t) for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    get = words.get
    return np.fromiter((get(w, 0) for p in parts for w in p), np.int32, offsets[-1]), offsets


def count_words(documents: DataFrame, words: dict[bytes, int]) -> np.ndarray:
    """How often each known word is in all documents; entry 0 counts all other words."""
    shared = Shipped(documents.sparkSession, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.load()
        total = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for texts in text_blocks(batch, "text"):
                total += np.bincount(_word_ids(texts, words)[0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["word", "n"])

    got = documents.select("text").mapInArrow(tidy(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) + 1, np.int64)
    out[got["word"].to_numpy()] = got["n"].to_numpy()
    return out


def build_index(documents: DataFrame, item_ids: list, texts: list[bytes], min_bits: float) -> Index:
    parts = [text_words(t) for t in texts]
    words = {w: i for i, w in enumerate(sorted({w for p in parts for w in p}), 1)}
    counts = count_words(documents, words)
    bits = -np.log2((counts + 1) / (counts.sum() + len(counts)))
    items, codes, places = [], [], []
    for i, p in enumerate(parts):
        ids = np.array([words[w] for w in p], np.int32)
        items.append(ids)
        size = len(ids) - SEED + 1
        if size <= 0:
            continue
        info = sum(bits[ids[j : j + size]] for j in range(SEED))
        chosen = info >= min_bits
        chosen[np.argsort(-info, kind="stable")[:LEAST_SEEDS]] = True
        at = np.flatnonzero(chosen)
        codes.append(_pack(ids)[at])
        places.append(np.stack([np.full(len(at), i), at], 1))
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    place = np.concatenate(places) if places else np.zeros((0, 2), np.int64)
    order = np.argsort(code, kind="stable")
    return Index(item_ids, items, words, code[order], place[order])


def align(pairs: list[tuple[np.ndarray, np.ndarray]], mismatch: int = MISMATCH, gap: int = GAP) -> np.ndarray:
    """Smith-Waterman of each (item, region): best score, first and last word of the region in it, matched words.

    All pairs advance together, one anti-diagonal at a time.
    """
    b, m, n = len(pairs), max(len(x) for x, _ in pairs), max(len(y) for _, y in pairs)
    item, region = np.full((b, m), -1, np.int32), np.full((b, n), -2, np.int32)
    for k, (x, y) in enumerate(pairs):
        item[k, : len(x)], region[k, : len(y)] = x, y
    state = [np.zeros((b, m + 1, 3), np.int32) for _ in range(2)]  # diagonals t-2, t-1: score, first word, matches; row 0 is the border
    best = np.zeros((b, 4), np.int64)
    rows = np.arange(b)
    for t in range(m + n - 1):
        lo, hi = max(0, t - n + 1), min(m, t + 1)  # item positions on this diagonal
        i = np.arange(lo, hi)
        j = t - i
        same = item[:, lo:hi] == region[:, j]
        diagonal, up, left = state[0][:, lo:hi], state[1][:, lo:hi], state[1][:, lo + 1 : hi + 1]
        now = np.zeros((b, m + 1, 3), np.int32)
        score = diagonal[..., 0] + np.where(same, MATCH, mismatch)
        fresh = diagonal[..., 0] <= 0
        first = np.where(fresh, j, diagonal[..., 1])
        matched = np.where(fresh, 0, diagonal[..., 2]) + same
        for other in (up, left):
            s = other[..., 0] + gap
            better = s > score
            score, first, matched = np.where(better, s, score), np.where(better, other[..., 1], first), np.where(better, other[..., 2], matched)
        score = np.maximum(score, 0)
        now[:, lo + 1 : hi + 1, 0], now[:, lo + 1 : hi + 1, 1], now[:, lo + 1 : hi + 1, 2] = score, first, matched
        k = score.argmax(1)
        top = score[rows, k]
        won = top > best[:, 0]
        best[won] = np.stack([top, first[rows, k], j[k], matched[rows, k]], 1)[won]
        state = [state[1], now]
    return best


def _find(index: Index, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, start, end) of every region that seeds point to."""
    codes = _pack(ids)
    at = np.flatnonzero(codes)
    lengths = np.diff(offsets)
    owner = np.searchsorted(offsets, at, side="right") - 1
    at, owner = at[at + SEED <= offsets[owner + 1]], owner[at + SEED <= offsets[owner + 1]]
    lo, hi = np.searchsorted(index.seeds, codes[at], "left"), np.searchsorted(index.seeds, codes[at], "right")
    n = hi - lo
    at, owner, lo, n = at[n > 0], owner[n > 0], lo[n > 0], n[n > 0]
    each = np.repeat(np.arange(len(at)), n)
    entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, pos = index.places[entry].T if len(entry) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    text, diagonal = owner[each], at[each] - offsets[owner[each]] - pos
    order = np.lexsort((diagonal, item, text))
    out, last = [], None
    for t, k, d in zip(text[order].tolist(), item[order].tolist(), diagonal[order].tolist()):
        m = len(index.items[k])
        pad = m // 4 + SEED
        start, end = max(d - pad, 0), min(d + m + pad, int(lengths[t]))
        if last and last[:2] == [t, k] and start <= last[3]:
            last[3] = end
        else:
            last = [t, k, start, end]
            out.append(last)
    return [tuple(x) for x in out]


def align_regions(index: Index, ids: np.ndarray, offsets: np.ndarray, min_score: float) -> dict[tuple[int, int], tuple]:
    """(text, item) -> (score, first word, last word, matched words) of the best alignment that is good enough."""
    regions = _find(index, ids, offsets)
    regions.sort(key=lambda r: (len(index.items[r[1]]), r[3] - r[2]))
    found: dict[tuple[int, int], tuple] = {}
    at = 0
    while at < len(regions):
        end = at + 1
        while end < len(regions) and (end - at + 1) * len(index.items[regions[end][1]]) <= CELLS:
            end += 1
        some = regions[at:end]
        pairs = [(index.items[k], ids[offsets[t] + a : offsets[t] + b]) for t, k, a, b in some]
        got = align(pairs)
        whole = got[:, 0] / (MATCH * np.array([len(x) for x, _ in pairs])) >= min_score
        # an alignment scores at least as much as it does where changes cost more
        part = np.flatnonzero(~whole & (got[:, 0] >= MATCH * RUN))
        if len(part):
            whole[part] = align([pairs[i] for i in part], STRICT, STRICT)[:, 0] >= MATCH * RUN
        for (t, k, a, _), (top, first, last, matched), good in zip(some, got.tolist(), whole.tolist()):
            score = top / (MATCH * len(index.items[k]))
            row = (score, a + first, a + last, matched)
            if good and ((t, k) not in found or (row[0], -row[1]) > (found[t, k][0], -found[t, k][1])):
                found[t, k] = row
        at = end
    return found


def _blocks(documents: DataFrame, benchmark: DataFrame, min_bits: float) -> Iterator[Index]:
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    n = max(1, -(-items.count() // ITEMS_AT_ONCE))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()  # about ITEMS_AT_ONCE
        if block.num_rows:
            yield build_index(documents, block["item_id"].to_pylist(), [t.encode() for t in block["text"].to_pylist()], min_bits)


def find_copies(documents: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, min_bits: float = MIN_BITS) -> DataFrame:
    """A row for each document and test item with an alignment of ``min_score`` of a whole copy or the strength of RUN words."""
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = documents.sparkSession.createDataFrame([], SCHEMA)
    for index in _blocks(documents, benchmark, min_bits):
        out = out.unionAll(_match(documents, index, min_score))
    return out


def drop_copies(documents: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, min_bits: float = MIN_BITS) -> DataFrame:
    """``documents`` without those that ``find_copies`` has a row for; one pass, no shuffle."""
    out = documents
    for index in _blocks(documents, benchmark, min_bits):
        out = _without(out, index, min_score)
    return out


def _without(documents: DataFrame, index: Index, min_score: float) -> DataFrame:
    shared = Shipped(documents.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.load()
        for batch in batches:
            clean, a = np.ones(batch.num_rows, bool), 0
            for texts in text_blocks(batch, "text"):
                clean[[a + t for t, _ in align_regions(index, *_word_ids(texts, index.words), min_score)]] = False
                a += len(texts)
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(tidy(run), documents.schema)


def _match(documents: DataFrame, index: Index, min_score: float) -> DataFrame:
    shared = Shipped(documents.sparkSession, index)  # one block of test items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.load()
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            texts, ids = byte_column(batch, "text"), batch.column(0).to_pylist()
            rows = []
            for a, b in blocks([len(t) for t in texts]):
                for (t, k), row in sorted(align_regions(index, *_word_ids(texts[a:b], index.words), min_score).items()):
                    rows.append((ids[a + t], index.item_ids[k], *row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.mapInArrow(tidy(run), SCHEMA)
