"""Jaccard join of word shingles by prefix filters under several global orders (operator 9).

A text's set are its distinct 5-word shingles of lower-cased words.  Under any global
order of the shingles, two sets with Jaccard similarity t share one among their first
n - ceil(t * n) + 1 shingles.  The first order puts frequent shingles last (counted over
all texts; ties by a hash); its prefixes are indexed, so a passage that many texts share
makes no candidates.  Candidates must also pass the length and
the position filter there, and share prefix shingles under every further order, before
their whole sets are compared.  Between the two stands a bitmap of each set, a few bits
for each shingle: sets differ by at least the bits in which the parities of their
bitmaps differ, which rules out most of what shares only a passage, exactly.

Equal sets are one class from the start (their postings are the same rows).  In an index
list with many sets only pairs with the list's first set are candidates at once, and of
those one for each set; what that leaves open - sets of a list that are not yet in one
component - is compared in further rounds: two that take a set's most promising partner
in another component, and a last one that takes all that remain.  So a large group of
near copies costs rows for each copy rather than for each pair, and no link between two
components is lost.

Texts are read again for the comparison; a Bloom filter of bounded size keeps most
texts without a candidate out of that shuffle (full, it would only let all of them in).

Edge cases: null and empty texts have no set, n_shingles 0 and themselves as component;
rows without a doc_id are compared only by equality of sets; of rows with one doc_id and
different texts only the least text is compared with others;
texts of fewer than five words are one shingle; very long texts are taken whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch, Shipped, blocks, byte_column, gram_codes, mix, text_blocks, tidy, word_codes, word_memo
from monthpick.llm.components import components

WORDS = 5
#: Similarity as a fraction.
NUM, DEN = 3, 4
#: Further orders that candidates must share a prefix shingle under.
ORDERS = (2, 3)
#: Bits of a shingle that is counted, codes that a task counts at once, slices of the codes at least and bytes of text for each.
COUNT_BITS, COUNT_AT_ONCE, SLICES, SLICE_BYTES = 40, 1 << 22, 64, 8 << 20
#: Shingles in fewer texts than twice this are in the first class; of the others so many, the most frequent, have a higher one.
RARE, FREQUENT = 8, 1 << 20
#: Longest index list whose pairs are all candidates at once.
LIST = 16
#: Documents for each bucket of the index, and buckets at least.
BUCKET_DOCS, BUCKETS = 1_000, 64
#: Bits of the Bloom filter at most (8 MB).
BLOOM_BITS = 1 << 26
#: A shingle's 40 bits (a chance match only makes a candidate more), a document that has the set, place and set size.
_POSTING = np.dtype([("token", "<u4"), ("rest", "u1"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])


def shingle_sets(texts: list[bytes], memo) -> list[np.ndarray]:
    """Sorted distinct shingle codes of each text."""
    codes, offsets = word_codes([t.lower() for t in texts], memo)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out.append(np.unique(gram_codes(codes[a:b], min(WORDS, b - a))) if b > a else np.empty(0, np.uint64))
    return out


def set_code(codes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(codes.tobytes())


def prefix_length(n):
    return n - -(-n * NUM // DEN) + 1


def needed_overlap(a, b):
    """Least intersection of sets of sizes a and b that are similar enough."""
    return -(-(a + b) * NUM // (NUM + DEN))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Prefix filters under the further orders, then the exact comparison of two sets."""
    for order in ORDERS:
        pa_, pb = prefix_length(len(a)), prefix_length(len(b))
        x, y = mix(a, order), mix(b, order)
        x, y = np.partition(x, pa_ - 1)[:pa_], np.partition(y, pb - 1)[:pb]
        if not len(np.intersect1d(x, y, assume_unique=True)):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def parity_bits(codes: np.ndarray) -> bytes:
    """Parity of the shingles on each bit; the size is the power of two from n on, 64 at least."""
    size = 64
    while size < len(codes):
        size *= 2
    counts = np.bincount((mix(codes, 4) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def room(a: bytes, b: bytes, na: int, nb: int) -> int:
    """Shingles that similar sets may differ in, less those that the bitmaps show to differ; negative: not similar."""
    x, y, size_x, size_y = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)
    while size_x > size_y:
        size_x //= 2
        x = (x >> size_x) ^ (x & ((1 << size_x) - 1))
    while size_y > size_x:
        size_y //= 2
        y = (y >> size_y) ^ (y & ((1 << size_y) - 1))
    return na + nb - 2 * needed_overlap(na, nb) - (x ^ y).bit_count()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _count_slices(codes: np.ndarray, slices: int) -> list[tuple[int, bytes]]:
    """(slice, packed) of counted codes (sorted in place); a slice is a range of codes."""
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts, codes = np.diff(first, append=len(codes)), codes[first]
    at = (codes * np.uint64(slices) >> np.uint64(COUNT_BITS)).astype(np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    return [(int(at[i]), _pack_counts(x, n)) for i, x, n in zip(starts, np.split(codes, starts[1:]), np.split(counts, starts[1:]))]


def _pack_counts(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between sorted codes and the counts, byte by byte of their places."""
    planes = [np.diff(codes, prepend=np.uint64(0)).astype("<u8"), counts.astype("<u4")]
    return zstandard.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in planes), 1)


def _unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n = len(data) // 12
    steps, counts = (np.ascontiguousarray(x.reshape(-1, n).T) for x in (data[: 8 * n], data[8 * n :]))
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), counts.view("<u4").ravel().astype(np.int64)


def _sets_and_counts(documents: DataFrame, slices: int) -> DataFrame:
    """Rows of documents (doc_id, n, code, bits) and of slices of the shingle counts (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            codes = np.concatenate(held)
            held.clear()
            found = _count_slices(codes, slices)
            nothing = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.nulls(len(found), pa.binary()), pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=names)

        for batch in batches:
            n, code, bits = [], [], []
            for texts in text_blocks(batch, "text"):
                sets = shingle_sets(texts, memo)
                n += map(len, sets)
                code += [set_code(s) for s in sets]
                bits += [parity_bits(s) for s in sets]
                held.append(np.concatenate(sets) >> np.uint64(64 - COUNT_BITS))
                if sum(map(len, held)) >= COUNT_AT_ONCE:
                    yield counted()
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(_signed(np.array(code, np.uint64)), pa.int64()), pa.array(bits, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if sum(map(len, held)):
            yield counted()

    names = ["doc_id", "n", "code", "bits", "slice", "counts"]
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, n bigint, code bigint, bits binary, slice int, counts binary")


def _frequent(counts: DataFrame, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of frequent shingles and their classes, the binary logarithm of count / RARE; FREQUENT at most."""
    most = -(-FREQUENT // slices)

    def add(table: pa.Table) -> pa.Table:
        codes, counts = map(np.concatenate, zip(*map(_unpack_counts, table["counts"].to_pylist())))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        codes, counts = codes[starts], np.add.reduceat(counts, starts)
        often = np.flatnonzero(counts >= 2 * RARE)
        often = np.sort(often[np.argsort(-counts[often], kind="stable")[:most]])
        return pa.table({"codes": pa.array([codes[often].tobytes()], pa.binary()), "classes": pa.array([np.log2(counts[often] / RARE).astype(np.uint8).tobytes()], pa.binary())})

    got = counts.groupBy("slice").applyInArrow(add, "codes binary, classes binary").toArrow().to_pydict()
    codes, classes = np.frombuffer(b"".join(got["codes"]), np.uint64), np.frombuffer(b"".join(got["classes"]), np.uint8)
    order = np.argsort(codes)
    return codes[order], classes[order]


def _classes(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Frequency class of each shingle."""
    known, classes = frequent
    if not len(known):
        return np.zeros(len(shingles), np.uint64)
    codes = shingles >> np.uint64(64 - COUNT_BITS)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, classes[at], 0).astype(np.uint64)


def _postings(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(bucket, blob): the indexed prefixes under the first order."""
    shared = Shipped(documents.sparkSession, frequent)  # FREQUENT codes at most (9 MB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, memo = shared.load(), word_memo()
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            parts, seen = [], set()
            for texts in text_blocks(batch, "text"):
                for s, doc in zip(shingle_sets(texts, memo), ids):
                    if not len(s) or (code := set_code(s)) in seen:  # one document of a batch stands for equal sets
                        continue
                    seen.add(code)
                    p = prefix_length(len(s))
                    rank = mix(s, 1) >> np.uint64(8) | _classes(s, frequent) << np.uint64(56)
                    first = np.argpartition(rank, p - 1)[:p]
                    first = first[np.argsort(rank[first])]
                    rows = np.empty(p, _POSTING)
                    rows["token"], rows["rest"], rows["doc"], rows["at"], rows["n"] = s[first] & np.uint64(0xFFFFFFFF), s[first] >> np.uint64(32) & np.uint64(255), doc, np.arange(p), len(s)
                    parts.append(rows)
            if not parts:
                continue
            rows = np.concatenate(parts)
            bucket = (mix(rows["token"].astype(np.uint64), 9) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [_pack(x) for x in np.split(rows, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "bucket int, blob binary")


def _pack(rows: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in _POSTING.names), 1)


def _unpack(blobs: list[bytes]) -> np.ndarray:
    parts = []
    for blob in blobs:
        data = zstandard.decompress(blob)
        n, at = len(data) // _POSTING.itemsize, 0
        rows = np.empty(n, _POSTING)
        for f in _POSTING.names:
            kind = _POSTING[f]
            rows[f] = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
        parts.append(rows)
    return np.concatenate(parts) if parts else np.empty(0, _POSTING)


def _passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length and position filter of pairs of postings, taken as the pairs' first common shingles."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    least = needed_overlap(na, nb)
    return (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & (1 + np.minimum(na - a["at"] - 1, nb - b["at"] - 1) >= least)


def _unique_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    a = np.concatenate([x["doc"] for x, _ in parts] or [np.empty(0, np.int64)])
    b = np.concatenate([y["doc"] for _, y in parts] or [np.empty(0, np.int64)])
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _candidates(postings: DataFrame) -> DataFrame:
    """(a, b) pairs of documents, with at = 1 where a is the first of a long list; (a, token, at, n) with b null: postings of long lists."""

    def run(table: pa.Table) -> pa.Table:
        rows = _unpack(table["blob"].to_pylist())
        token = rows["token"].astype(np.int64) << 8 | rows["rest"]
        order = np.lexsort((rows["doc"], token))
        rows, token = rows[order], token[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(rows) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(rows)))
        long_list = np.repeat(size > LIST, size)
        first = np.repeat(start, size)
        parts = []
        at = np.flatnonzero(long_list)
        leader, member = rows[first[at]], rows[at]
        fine = _passes(leader, member) & (leader["doc"] != member["doc"])
        star = np.unique(np.stack([leader["doc"][fine], member["doc"][fine]], 1), axis=0)
        short, short_token = rows[~long_list], token[~long_list]
        for d in range(1, LIST):
            fine = short_token[:-d] == short_token[d:]
            if not fine.any():
                break
            x, y = short[:-d][fine], short[d:][fine]
            fine = _passes(x, y)
            parts.append((x[fine], y[fine]))
        pairs = _unique_pairs(parts)
        kind = pa.array(np.concatenate([np.zeros(len(pairs), np.int64), np.ones(len(star), np.int64)]))
        pairs = np.concatenate([pairs, star])
        blank = pa.nulls(len(pairs), pa.int64())
        out = pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1]), "token": blank, "at": kind, "n": blank})
        left = rows[long_list]
        open_lists = pa.table({"a": left["doc"].copy(), "b": pa.nulls(len(left), pa.int64()), "token": token[long_list], "at": left["at"].astype(np.int64), "n": left["n"].astype(np.int64)})
        return pa.concat_tables([out, open_lists])

    return postings.groupBy("bucket").applyInArrow(run, "a bigint, b bigint, token bigint, at bigint, n bigint")


def _open_pairs(lists: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of heads in one long list that are in different components and not ruled out by their bitmaps.

    Every head outside the list's largest component meets all heads of other
    components; with ``nearest`` only its pair with the most room stays.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = np.empty(table.num_rows, _POSTING)
        rows["doc"], rows["at"], rows["n"] = (table[c].to_numpy() for c in ("id", "at", "n"))
        component, bits = table["component"].to_numpy(), table["bits"].to_pylist()
        labels, sizes = np.unique(component, return_counts=True)
        most = labels[sizes.argmax()]
        pairs = set()
        for k in np.flatnonzero(component != most).tolist():
            other = np.flatnonzero(component != component[k])
            other = other[_passes(np.repeat(rows[k : k + 1], len(other)), rows[other])]
            rooms = [(room(bits[k], bits[j], int(rows["n"][k]), int(rows["n"][j])), j) for j in other.tolist()]
            rooms = [x for x in rooms if x[0] >= 0]
            for _, j in [max(rooms)] if nearest and rooms else rooms:
                pairs.add((min(int(rows["doc"][k]), int(rows["doc"][j])), max(int(rows["doc"][k]), int(rows["doc"][j]))))
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return lists.groupBy("token").applyInArrow(run, "a bigint, b bigint")


def _near_by_bits(pairs: DataFrame) -> DataFrame:
    """The id pairs whose bitmaps do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [room(*x) >= 0 for x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("id_a", "id_b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(run, "a bigint, b bigint")


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of the ids of a column ``id``: 16 for each up to BLOOM_BITS, two set for each."""
    size = 1 << 16
    n = ids.count()
    while size < min(16 * n, BLOOM_BITS):
        size *= 2
    slices = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_bloom_places(batch.column(0).to_numpy(), size)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([zstandard.compress(np.packbits(x).tobytes()) for x in np.split(bits, slices)], pa.binary())], names=["slice", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(zstandard.decompress(x), np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"slice": table["slice"][:1].combine_chunks(), "bits": pa.array([bits.tobytes()], pa.binary())})

    got = ids.select("id").mapInArrow(run, "slice int, bits binary").groupBy("slice").applyInArrow(join, "slice int, bits binary").toArrow().to_pydict()
    out = np.zeros((slices, size // slices // 8), np.uint8)
    for k, bits in zip(got["slice"], got["bits"]):
        out[k] = np.frombuffer(bits, np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def _bloom_places(ids: np.ndarray, size: int) -> np.ndarray:
    x = np.asarray(ids, np.int64).view(np.uint64)
    return np.concatenate([(mix(x, k) & np.uint64(size - 1)).astype(np.int64) for k in (6, 7)])


def _with_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents whose id is in ``ids``; of rows with one id the least text."""
    shared = Shipped(documents.sparkSession, np.packbits(_bloom(ids)))  # BLOOM_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.load()).astype(bool)
        for batch in batches:
            places = _bloom_places(batch.column(0).to_numpy(), len(bits)).reshape(2, -1)
            yield batch.filter(pa.array(bits[places].all(0)))

    source = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return source.mapInArrow(run, source.schema).join(ids, "id").groupBy("id").agg(F.min("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (ids of ``texts``: id, text) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            left, right = byte_column(batch, "text_a"), byte_column(batch, "text_b")
            keep = []
            for a, b in blocks([len(x) + len(y) for x, y in zip(left, right)]):
                once = sorted(set(left[a:b]) | set(right[a:b]))
                sets = dict(zip(once, shingle_sets(once, memo)))
                keep += [similar(sets[x], sets[y]) for x, y in zip(left[a:b], right[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a bigint, b bigint")


def jaccard_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id reachable by links."""
    scratch = Scratch(documents.sparkSession, "jaccard-join")
    size = documents.select(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(SLICES, size // SLICE_BYTES)
    first = scratch.stage(_sets_and_counts(documents, slices))
    sets = first.where("slice IS NULL").select("doc_id", "n", "code", "bits")
    frequent = _frequent(first.where("slice IS NOT NULL"), slices)
    buckets = max(BUCKETS, sets.count() // BUCKET_DOCS)
    found = scratch.stage(_candidates(_postings(documents, frequent, buckets)))
    heads = sets.where("n > 0").groupBy("code").agg(F.min("doc_id").alias("id"))
    # each document's head: the smallest doc_id with an equal set
    who = scratch.stage(sets.where("n > 0 AND doc_id IS NOT NULL").join(heads, "code").select("doc_id", "id", "n", "bits"))

    def verified(pairs: DataFrame) -> DataFrame:
        ids = scratch.stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        return scratch.stage(_verified(pairs, _with_ids(documents, ids)))

    star = found.where("b IS NOT NULL AND at = 1").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first_pairs = found.where("b IS NOT NULL AND at = 0").select("a", "b").unionByName(star)
    a, b = (who.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "bits")]) for x in "ab")
    near = _near_by_bits(first_pairs.join(a, "a").join(b, "b").where("id_a <> id_b"))
    tested = scratch.stage(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = verified(tested)
    roots = scratch.stage(components(links, scratch))
    lists = found.where("b IS NULL").join(who.select(F.col("doc_id").alias("a"), "id"), "a").groupBy("token", "id").agg(F.min("at").alias("at"), F.first("n").alias("n"))
    lists = scratch.stage(lists)
    bits = who.where("doc_id = id").select("id", "bits").dropDuplicates(["id"])
    for nearest in (True, True, False):
        # lists whose sets are all in one component are done
        named = lists.join(roots, "id", "left").withColumn("component", F.coalesce("component", "id"))
        still = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
        more = _open_pairs(named.join(still, "token").join(bits, "id"), nearest).distinct().join(tested, ["a", "b"], "left_anti")
        more = scratch.stage(more)
        if more.isEmpty():
            continue
        links, tested = links.unionByName(verified(more)), tested.unionByName(more)
        roots = scratch.stage(components(links, scratch))
    named = sets.select("doc_id", "n", "code").join(heads.select("code", "id"), "code", "left").join(roots, "id", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One document of each class: the one with the smallest doc_id.  Of rows with one doc_id one stays; null ids stay."""
    scratch = Scratch(documents.sparkSession, "one-of-each")
    classes = scratch.stage(jaccard_classes(documents))
    ids = F.col("doc_id").cast("bigint")
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    nameless = documents.where("doc_id IS NULL")
    # the ids grow with the documents: the same join at every size
    out = documents.join(kept.hint("merge"), ids == F.col("_kept"), "left_semi")
    if classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out.unionByName(nameless)
    return out.dropDuplicates(["doc_id"]).unionByName(nameless)
