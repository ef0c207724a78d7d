"""Substring deduplication by prefix-partitioned suffix trees (operator 1).

Words are ``[^\\x20\\x09-\\x0D]+``.  A window is WINDOW consecutive words of one document;
a word goes if a window that covers it also starts in a document with a smaller doc_id.

1. Anchors: of the short grams inside each window the least by hash is posted; grams
   that only one document has end there.  Suffixes whose window has no shared anchor
   are leaves that branch off above the wanted depth and take no further part.
2. Prefixes: a sketch of all documents counts how often prefixes of 1, 2, 4, 8 and 13
   words begin a suffix.  Each remaining suffix goes to the group of its shortest prefix
   that has no more suffixes than fit in memory, so groups are subtrees of bounded size;
   a prefix of a whole window is one deep node however often it occurs.
3. Subtrees: suffixes of a group in lexical order with the longest common prefixes of
   neighbours are the subtree; runs of neighbours that share WINDOW words are the leaves
   below its deep internal nodes, the repeats.  All but those of the smallest doc_id are
   marked.
4. Marks return to their documents, where the covered words are removed.

Texts, postings, suffixes and marks travel as compressed blobs, one for each task and
bucket.  What many documents of one task share is marked there and posted once, so a
passage or copy that a third of all rows have costs a row for each task.

Edge cases: null and empty texts have no words (n_words 0, the digest of the empty
string); texts of fewer than 13 words stay whole; very long texts are taken whole; rows
with one doc_id do not remove words from each other, and each loses its own repeats
whatever the others' texts; a null doc_id counts as larger than all others; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch, Shipped, blocks, byte_column, gram_codes, mix, word_codes, word_memo

WINDOW, GRAM = 13, 6
LEVELS = (1, 2, 4, 8)
#: Suffixes of one group at most (by the sketch, which never counts too low).
GROUP = 200_000
SKETCH_BITS, SLICES = 18, 16
#: Documents for each bucket, and buckets at least.
BUCKET_DOCS, BUCKETS = 4_000, 64
NO_ID = np.iinfo(np.int64).max
#: Kinds of blobs: texts, places of shared anchors, places of removed windows, slices of the sketch, postings or suffixes.
TEXT, ANCHOR, REMOVED, SKETCH, POST = range(5)
_SCHEMA = "kind int, bucket int, blob binary"
#: An anchor's code needs no more than 40 bits: a chance match only keeps a suffix for the exact step.
_POST = np.dtype([("code", "<u4"), ("rest", "u1"), ("doc", "<i8"), ("at", "<u4"), ("many", "u1")])
_PLACE = np.dtype([("doc", "<i8"), ("at", "<u4")])
#: A suffix down to the wanted depth: 13 symbols of 8 bits (8 in k0, 5 in k1), then 24 + 32 bits of the
#: window's own code as its last symbols, so that equal keys are equal words.
_SUFFIX = np.dtype([("k0", "<u8"), ("k1", "<u8"), ("k2", "<u4"), ("doc", "<i8"), ("at", "<u4")])


def _pack(rows: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names), 1)


def _unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        data, at = zstandard.decompress(blob), 0
        rows = np.empty(len(data) // kind.itemsize, kind)
        for f in kind.names:
            rows[f] = np.frombuffer(data, kind[f], len(rows), at)
            at += len(rows) * kind[f].itemsize
        parts.append(rows)
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _pack_texts(ids: list[int], texts: list[bytes]) -> bytes:
    head = np.array([len(ids), *ids, *map(len, texts)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(texts), 3)


def _unpack_texts(blob: bytes) -> Iterator[tuple[int, bytes]]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, sizes = np.frombuffer(data, np.int64, 2 * n, 8).reshape(2, n).tolist()
    at = 8 * (2 * n + 1)
    for i, size in zip(ids, sizes):
        yield i, data[at : at + size]
        at += size


def _offsets(blobs: list[bytes]) -> dict[int, dict[bytes, int]]:
    """Of documents with several different texts: where each text's words begin when the texts stand one behind the other."""
    times: dict[int, int] = {}
    for blob in blobs:
        with zstandard.ZstdDecompressor().stream_reader(blob) as head:
            n = int(np.frombuffer(head.read(8), np.int64)[0])
            for i in np.frombuffer(head.read(8 * n), np.int64).tolist():
                times[i] = times.get(i, 0) + 1
    several: dict[int, set[bytes]] = {i: set() for i, n in times.items() if n > 1}
    for blob in blobs if several else ():
        for i, text in _unpack_texts(blob):
            if i in several:
                several[i].add(text)
    out = {}
    for i, texts in several.items():
        if len(texts) > 1:
            ends = np.cumsum([0, *[len(t.split()) for t in sorted(texts)]]).tolist()
            out[i] = dict(zip(sorted(texts), ends))
    return out


def _by_document(places: np.ndarray) -> dict[int, np.ndarray]:
    """Word positions by document."""
    docs = np.ascontiguousarray(places["doc"])
    order = np.argsort(docs, kind="stable")
    docs, at = docs[order], places["at"][order].astype(np.int64)
    starts = _runs(docs)
    return dict(zip(docs[starts].tolist(), np.split(at, starts[1:])))


def _doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.asarray(ids, np.int64).view(np.uint64), 5) % np.uint64(buckets)).astype(np.int64)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["kind", "bucket", "blob"])


def _by_bucket(kind: int, rows: np.ndarray, bucket: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(kind, int(b), _pack(x)) for b, x in zip(bucket[starts], np.split(rows, starts[1:]))] if len(rows) else []


def _minimizers(codes: np.ndarray) -> np.ndarray:
    """For each window of a text the place of its least gram (the first of equals)."""
    if len(codes) < WINDOW:
        return np.empty(0, np.int64)
    inside = WINDOW - GRAM + 1
    grams = np.lib.stride_tricks.sliding_window_view(gram_codes(codes, GRAM), inside)
    return grams.argmin(1) + np.arange(len(grams))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _shared_places(posts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of their code, whether each is shared by documents, and the runs' starts."""
    code = posts["code"].astype(np.uint64) << np.uint64(8) | posts["rest"]
    order = np.argsort(code)
    posts, starts = posts[order], _runs(code[order])
    if not len(posts):
        return posts, np.empty(0, bool), starts
    sizes = np.diff(np.append(starts, len(posts)))
    several = (np.maximum.reduceat(posts["doc"], starts) != np.minimum.reduceat(posts["doc"], starts)) | np.logical_or.reduceat(posts["many"] > 0, starts)
    return posts, np.repeat(several, sizes), starts


def _places(posts: np.ndarray) -> np.ndarray:
    out = np.empty(len(posts), _PLACE)
    out["doc"], out["at"] = posts["doc"], posts["at"]
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def _anchors(documents: DataFrame, buckets: int) -> DataFrame:
    """Blobs of postings by code, and of anchor places that are shared within a batch by document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            ids, texts, parts = _ids(batch.column(0)), byte_column(batch, "text"), []
            for a, b in blocks([len(t) for t in texts]):
                codes, offsets = word_codes(texts[a:b], memo)
                for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = codes[lo:hi]
                    at = np.unique(_minimizers(own))
                    if not len(at):
                        continue
                    post, code = np.empty(len(at), _POST), gram_codes(own, GRAM)[at]
                    post["code"], post["rest"], post["doc"], post["at"], post["many"] = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32) & np.uint64(255), ids[a + i], at, 0
                    parts.append(post)
            if not parts:
                continue
            posts, shared, starts = _shared_places(np.concatenate(parts))
            # shared within this batch: marked here, and posted once for the other tasks
            local = _places(posts[shared])
            posts["many"] = shared
            once = ~shared
            once[starts] = True
            posts = posts[once]
            yield _batch(_by_bucket(ANCHOR, local, _doc_bucket(local["doc"], buckets)) + _by_bucket(POST, posts, (mix(posts["code"].astype(np.uint64), 3) % np.uint64(buckets)).astype(np.int64)))

    return documents.mapInArrow(run, _SCHEMA)


def _texts(documents: DataFrame, buckets: int) -> DataFrame:
    """Blobs of whole texts by document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rows = _ids(batch.column(0)), byte_column(batch, "text"), []
            home = _doc_bucket(ids, buckets)
            for k in np.unique(home).tolist():
                own = np.flatnonzero(home == k).tolist()
                for x, y in blocks([len(texts[i]) for i in own]):
                    rows.append((TEXT, k, _pack_texts([int(ids[i]) for i in own[x:y]], [texts[i] for i in own[x:y]])))
            yield _batch(rows)

    return documents.mapInArrow(run, _SCHEMA)


def _counter(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _prefix_counts(documents: DataFrame) -> np.ndarray:
    """How many suffixes of all documents begin with the prefixes of each counter, by level; fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sketch = word_memo(), np.zeros((len(LEVELS), 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            texts = byte_column(batch, "text")
            for a, b in blocks([len(t) for t in texts]):
                codes, _ = word_codes(texts[a:b], memo)
                for k, level in enumerate(LEVELS):
                    sketch[k] += np.bincount(_counter(gram_codes(codes, level)), minlength=sketch.shape[1])
        if sketch.any():
            yield _batch([(SKETCH, k, zstandard.compress(x.tobytes())) for k, x in enumerate(np.split(sketch.ravel(), SLICES))])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in table["blob"].to_pylist())
        return pa.Table.from_batches([_batch([(SKETCH, table["bucket"][0].as_py(), total.astype(np.int64).tobytes())])])

    got = documents.select("text").mapInArrow(count, _SCHEMA).groupBy("bucket").applyInArrow(add, _SCHEMA).toArrow().to_pydict()
    out = np.zeros((SLICES, (len(LEVELS) << SKETCH_BITS) // SLICES), np.int64)
    for k, blob in zip(got["bucket"], got["blob"]):
        out[k] = np.frombuffer(blob, np.int64)
    return out.reshape(len(LEVELS), -1)


def _matched_anchors(posts: DataFrame, buckets: int) -> DataFrame:
    """Places of the grams that several documents have, by document bucket; places known before go through."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.equal(table["kind"], ANCHOR))
        rows, shared, _ = _shared_places(_unpack(table.filter(pa.compute.equal(table["kind"], POST))["blob"].to_pylist(), _POST))
        found = _places(rows[shared & (rows["many"] == 0)])
        return pa.concat_tables([known, pa.Table.from_batches([_batch(_by_bucket(ANCHOR, found, _doc_bucket(found["doc"], buckets)))])])

    return posts.groupBy("bucket").applyInArrow(run, _SCHEMA)


def _group_code(codes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Code of the prefix whose group each suffix belongs to: the shortest that is rare enough, else the window."""
    out = gram_codes(codes, WINDOW)[starts]
    undecided = np.ones(len(starts), bool)
    for k, level in enumerate(LEVELS):
        prefix = gram_codes(codes, level)[starts]
        here = undecided & (counts[k][_counter(prefix)] <= GROUP)
        out[here] = prefix[here] + np.uint64(level)
        undecided &= ~here
    return mix(out, 7)


def _packed_symbols(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight symbols (bytes) of each window in one number, and the others in another: pairs and fours are put together once for all windows."""
    two = symbols[:-1] << np.uint64(8) | symbols[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    first, rest = four[starts] << np.uint64(32) | four[starts + 4], four[starts + 8]
    for j in range(12, WINDOW):
        rest = rest << np.uint64(8) | symbols[starts + j]
    return first, rest


def _suffixes(bucketed: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """Blobs of suffixes by their prefix's group, and places of windows that are repeats within the bucket already."""
    shared = Shipped(bucketed.sparkSession, counts)  # fixed size

    def run(table: pa.Table) -> pa.Table:
        counts, memo, parts, groups = shared.load(), word_memo(), [], []
        kinds, data = np.array(table["kind"].to_pylist()), table["blob"].to_pylist()
        places = _unpack([data[i] for i in np.flatnonzero(kinds == ANCHOR)], _PLACE)
        of, offsets = _by_document(places), _offsets([data[k] for k in np.flatnonzero(kinds == TEXT)])
        for k in np.flatnonzero(kinds == TEXT):
            for doc, text in _unpack_texts(data[k]):
                anchors = of.get(doc)
                if anchors is None:
                    continue
                codes, _ = word_codes([text], memo)
                starts = np.flatnonzero(np.isin(_minimizers(codes), anchors))
                if not len(starts):
                    continue
                symbols, window = mix(codes, 1) >> np.uint64(56), gram_codes(codes, WINDOW)[starts]
                rows = np.empty(len(starts), _SUFFIX)
                first, rest = _packed_symbols(symbols, starts)
                rows["k0"], rows["k1"], rows["k2"] = first, rest << np.uint64(24) | window >> np.uint64(40), window & np.uint64(0xFFFFFFFF)
                rows["doc"], rows["at"] = doc, starts + offsets.get(doc, {}).get(text, 0)
                parts.append(rows)
                groups.append(_group_code(codes, starts, counts))
        if not parts:
            return pa.Table.from_batches([_batch([])])
        rows, group = np.concatenate(parts), np.concatenate(groups)
        order = np.lexsort((rows["doc"], rows["k2"], rows["k1"], rows["k0"]))
        rows, group = rows[order], group[order]
        starts = _runs(*[rows[f"k{f}"] for f in range(3)])
        sizes = np.diff(np.append(starts, len(rows)))
        local = rows["doc"] > np.repeat(rows["doc"][starts], sizes)  # a smaller document of this bucket has the window
        removed = _places(rows[local])
        mine = ~local
        return pa.Table.from_batches([_batch(_by_bucket(REMOVED, removed, _doc_bucket(removed["doc"], buckets)) + _by_bucket(POST, rows[mine], (group[mine] % np.uint64(buckets)).astype(np.int64)))])

    return bucketed.groupBy("bucket").applyInArrow(run, _SCHEMA)


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Symbols that each suffix of a sorted group shares with the one before it; WINDOW where the whole keys are equal."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) < 2:
        return out
    open_ = np.ones(len(rows) - 1, bool)
    first, rest = (rows[f][1:] ^ rows[f][:-1] for f in ("k0", "k1"))
    for different, shift in [(first, 56 - 8 * j) for j in range(8)] + [(rest, 56 - 8 * j) for j in range(WINDOW - 8)]:
        open_ &= (different >> np.uint64(shift)) & np.uint64(255) == 0
        out[1:] += open_
    # the check: below it are only leaves
    out[1:][open_ & ((rest != 0) | (rows["k2"][1:] != rows["k2"][:-1]))] -= 1
    return out


def _repeats(suffixes: DataFrame, buckets: int) -> DataFrame:
    """Places of windows below deep nodes whose smallest document is another one; places known before go through."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.equal(table["kind"], REMOVED))
        rows = _unpack(table.filter(pa.compute.equal(table["kind"], POST))["blob"].to_pylist(), _SUFFIX)
        rows = rows[np.lexsort((rows["doc"], rows["k2"], rows["k1"], rows["k0"]))]
        starts = np.flatnonzero(common_prefixes(rows) < WINDOW)
        sizes = np.diff(np.append(starts, len(rows)))
        removed = _places(rows[rows["doc"] > np.repeat(rows["doc"][starts], sizes)])
        return pa.concat_tables([known, pa.Table.from_batches([_batch(_by_bucket(REMOVED, removed, _doc_bucket(removed["doc"], buckets)))])])

    return suffixes.groupBy("bucket").applyInArrow(run, _SCHEMA)


def _cut(bucketed: DataFrame, with_text: bool) -> DataFrame:
    """The result rows of a bucket's documents."""

    def run(table: pa.Table) -> pa.Table:
        kinds, data = np.array(table["kind"].to_pylist()), table["blob"].to_pylist()
        places = _unpack([data[i] for i in np.flatnonzero(kinds == REMOVED)], _PLACE)
        of, offsets = _by_document(places), _offsets([data[k] for k in np.flatnonzero(kinds == TEXT)])
        ids, n_words, n_removed, digests, kept_texts = [], [], [], [], []
        for k in np.flatnonzero(kinds == TEXT):
            for doc, text in _unpack_texts(data[k]):
                words = text.split()
                at = of.get(doc)
                if at is not None:
                    at = at - offsets.get(doc, {}).get(text, 0)
                    at = at[(at >= 0) & (at + WINDOW <= len(words))]
                    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
                    kept = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                else:
                    kept = words
                joined = b" ".join(kept)
                ids.append(None if doc == NO_ID else doc)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode() if with_text else None)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept_texts, pa.string())})

    return bucketed.groupBy("bucket").applyInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def remove_repeats(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document; ``kept`` is null without ``with_text``."""
    scratch = Scratch(documents.sparkSession, "substring-dedup")
    buckets = max(BUCKETS, documents.count() // BUCKET_DOCS)
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = _prefix_counts(source)
    anchors = _matched_anchors(_anchors(source, buckets), buckets)
    suffixes = _suffixes(_texts(source, buckets).unionByName(anchors), counts, buckets)
    return scratch.stage(_cut(_texts(source, buckets).unionByName(_repeats(suffixes, buckets)), with_text))
