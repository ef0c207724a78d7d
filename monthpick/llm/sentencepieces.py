"""SentencePiece encoding and decoding with a unigram model (operator 4).

A piece vocabulary with log scores is loaded into a double-array trie; Viterbi finds
the segmentation with the highest score sum.  A character that no piece covers costs
10 below the lowest score and is written as byte pieces.  Spaces are marked by U+2581
and a marker is put before the text; a literal U+2581 is written as byte pieces, so
decoding gives back every text exactly.

No piece has the marker after another character, so the best path never crosses the
start of a run of markers: texts are cut there and each distinct part is solved once
per worker (a bounded memo).

Edge cases: null texts are encoded like empty ones (no pieces; a null stays null in
``text``); very long texts and words are encoded whole; of equal scores the path that
was found first (longest last piece) wins; other columns are ignored except those
named by ``keep``.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from monthpick.llm.common import Shipped, tidy

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Offset of the rank in the Zipf law that turns merge ranks into log scores.
ZIPF_OFFSET = 2.7
#: Parts of a text that pieces don't cross: a run of spaces, signs, then letters; or all up to the next space.
PARTS = r" *(?:(?![ \n])[\W\d_])*[^\W\d_]+| *(?:(?![ \n])[\W\d_])+|\n| +"
WIDE_PARTS = r" *[^ ]+| +"
#: Longer parts are solved one by one.
LONGEST_AT_ONCE = 64
#: Texts whose unseen parts are solved together.
TEXTS_AT_ONCE = 100
#: Of them, so many parts at a time.
PARTS_AT_ONCE = 8192
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(field number, value) pairs of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            at += 1
            shift += 7
            if data[at - 1] < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of every piece of a model file; type 1 normal, 6 byte."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            out.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, 1)))
    return out


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Log probabilities by Zipf's law for a vocabulary that is ordered by merge rank and has no probabilities."""
    ranks = np.cumsum([kind == 1 for _, _, kind in pieces])
    logs = -np.log(ranks + ZIPF_OFFSET)
    logs -= np.log(np.exp(logs[[kind == 1 for _, _, kind in pieces]]).sum())
    return [(piece, float(logs[i]) if kind == 1 else score, kind) for i, (piece, score, kind) in enumerate(pieces)]


class DoubleArrayTrie:
    """Children of node s by code c are at base[s] + c if check there is s."""

    def __init__(self, words: dict[str, int]):
        self.codes = {c: i for i, c in enumerate(sorted({c for w in words for c in w}), 1)}
        root: dict = {}
        for w, i in words.items():
            node = root
            for c in w:
                node = node.setdefault(self.codes[c], {})
            node[0] = i
        size = 1 << (4 * len(words) + 4 * len(self.codes) + 64).bit_length()
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        first, queue = 1, [(0, root)]
        for s, node in queue:
            value[s] = node.pop(0, -1)
            if not node:
                continue
            codes = np.array(sorted(node))
            while taken[first]:
                first += 1
            start = max(first - int(codes[0]), 1)
            while True:  # the first base whose places are all free, a window of bases at a time
                window = max(min(4096, size - start - int(codes[-1])), 0)
                clash = np.zeros(window, bool)
                for c in codes:
                    clash |= taken[start + c : start + c + window]
                if not clash.all():
                    start += int(clash.argmin())
                    break
                start += window
                if not window:
                    raise ValueError("the trie's arrays are full")
            base[s] = start
            for c in codes.tolist():
                taken[start + c], check[start + c] = True, s
                queue.append((start + c, node[c]))
        used = int(np.flatnonzero(taken)[-1]) + 1
        pad = len(self.codes) + 1  # a leaf's base leads to places that nobody owns
        base[np.flatnonzero(taken & (base == 0))] = used
        self.base, self.check, self.value = base[:used].tolist(), check[:used].tolist() + [-1] * pad, value[:used].tolist() + [-1] * pad


@dataclass
class Unigram:
    trie: DoubleArrayTrie
    scores: list[float]
    byte_ids: list[int]
    raw: list[bytes]  # what a piece decodes to
    unknown: float
    codes: dict[str, int]  # character of a text -> code in the trie
    split: str  # pattern of the parts that are solved on their own
    arrays: dict[str, np.ndarray] = field(init=False)

    def __post_init__(self):
        t = self.trie
        self.arrays = {"base": np.array(t.base, np.int32), "check": np.array(t.check, np.int32), "value": np.array(t.value, np.int32), "scores": np.array(self.scores)}

    @classmethod
    def load(cls, pieces: list[tuple[str, float, int]]) -> Unigram:
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece has a whitespace marker after another character")
        byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        back = {i: b for b, i in byte_ids.items()}
        raw = [bytes([back[i]]) if i in back else p.replace(MARK, " ").encode() if kind == 1 else b"" for i, (p, _, kind) in enumerate(pieces)]
        trie = DoubleArrayTrie(normal)
        codes = {c: k for c, k in trie.codes.items() if c != MARK} | ({" ": trie.codes[MARK]} if MARK in trie.codes else {})
        # letters end a part if no piece goes on after a letter with anything else
        words = not any("\n" in p or re.search(r"[^\W\d_][\W\d_]", p) for p in normal)
        return cls(trie, [s for _, s, _ in pieces], [byte_ids[b] for b in range(256)], raw, min(pieces[i][1] for i in normal.values()) - UNKNOWN_PENALTY, codes, PARTS if words else WIDE_PARTS)

    def solve(self, part: str) -> tuple[int, ...]:
        """Viterbi over one part, spaces unmarked."""
        base, check, value, scores, get = self.trie.base, self.trie.check, self.trie.value, self.scores, self.codes.get
        codes = [get(c, 0) for c in part]  # no node has a child by code 0
        codes.append(0)
        n = len(part)
        best, back, piece = [0.0] + [-math.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, s, j = best[i], 0, i
            t = base[0] + codes[i]
            if check[t] or value[t] < 0:  # no piece is this character alone
                best_next = here + self.unknown
                if best_next > best[i + 1]:
                    best[i + 1], back[i + 1], piece[i + 1] = best_next, i, -1
            while check[t] == s:
                s = t
                j += 1
                if (k := value[s]) >= 0 and (total := here + scores[k]) > best[j]:
                    best[j], back[j], piece[j] = total, i, k
                t = base[s] + codes[j]
        out: list[int] = []
        j = n
        while j:
            if piece[j] >= 0:
                out.append(piece[j])
            else:
                out += [self.byte_ids[b] for b in reversed(part[j - 1].encode())]
            j = back[j]
        out.reverse()
        return tuple(out)


    def solve_many(self, parts: list[str]) -> list[tuple[int, ...]]:
        """``solve`` of many parts at once: the same steps in the same order, each for all parts of one length."""
        out: dict[str, tuple[int, ...]] = {}
        by_length: dict[int, list[str]] = {}
        for part in parts:
            by_length.setdefault(len(part), []).append(part)
        base, check, value, scores = (self.arrays[k] for k in ("base", "check", "value", "scores"))
        for n, same in by_length.items():
            if n > LONGEST_AT_ONCE or len(same) < 8:
                out.update((part, self.solve(part)) for part in same)
                continue
            m, get = len(same), self.codes.get
            codes = np.zeros((n + 1, m), np.int32)
            codes[:n] = np.fromiter((get(c, 0) for part in same for c in part), np.int32, m * n).reshape(m, n).T
            best, back, piece = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int16), np.full((n + 1, m), -1, np.int32)
            best[0] = 0
            for i in range(n):
                t = base[0] + codes[i]
                alone = best[i] + self.unknown
                worse = ((check[t] != 0) | (value[t] < 0)) & (alone > best[i + 1])
                best[i + 1][worse], back[i + 1][worse], piece[i + 1][worse] = alone[worse], i, -1
                who, s, j = np.arange(m), np.zeros(m, np.int32), i
                while True:
                    on = check[t] == s
                    who, s = who[on], t[on]
                    if not len(who):
                        break
                    j += 1
                    k = value[s]
                    total = np.where(k >= 0, best[i][who] + scores[k], -np.inf)
                    better = total > best[j][who]
                    won = who[better]
                    best[j][won], back[j][won], piece[j][won] = total[better], i, k[better]
                    t = base[s] + codes[j][who]
            pieces, backs = piece.T.tolist(), back.T.tolist()
            for part, p, b in zip(same, pieces, backs):
                ids, j = [], n
                while j:
                    if p[j] >= 0:
                        ids.append(p[j])
                    else:
                        ids += [self.byte_ids[x] for x in reversed(part[j - 1].encode())]
                    j = b[j]
                ids.reverse()
                out[part] = tuple(ids)
        return [out[part] for part in parts]


class Codec:
    """Encoder and decoder of one worker; its memo has the ids of a part as bytes (int32), which take a third of a tuple's memory."""

    def __init__(self, model: Unigram, memo_parts: int = 160_000):
        self.model, self.limit = model, memo_parts
        self.parts = re.compile(model.split).findall
        self.memo: dict[str, bytes] = {}

    def encode_packed(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.parts(" " + t) if t else [] for t in texts]
        missing = list(set(chain.from_iterable(parts)) - self.memo.keys())
        if len(self.memo) + len(missing) > self.limit:  # start again; what is common comes back at once
            self.memo = {}
            missing = list(set(chain.from_iterable(parts)))
        for at in range(0, len(missing), PARTS_AT_ONCE):
            some = missing[at : at + PARTS_AT_ONCE]
            self.memo.update((part, array("i", ids).tobytes()) for part, ids in zip(some, self.model.solve_many(some)))
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_packed(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.model.raw.__getitem__, ids))[1:].decode(errors="replace")


def load_model(path: str = DEFAULT_MODEL) -> Unigram:
    return Unigram.load(zipf_scores(read_pieces(path)))


def encode(documents: DataFrame, model: Unigram, keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """(*keep, pieces array<int>, n_pieces, n_byte_pieces); with ``check`` also round_trip, whether decoding gives the text."""
    shared = Shipped(documents.sparkSession, model)  # the vocabulary: fixed size
    source = documents.select(*keep, *(["text"] if "text" not in keep else []))
    schema = T.StructType(source.select(*keep).schema.fields + [T.StructField("pieces", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType())] + [T.StructField("round_trip", T.BooleanType())] * check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.load())
        is_byte = np.zeros(len(codec.model.raw), bool)
        is_byte[codec.model.byte_ids] = True
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = [t or "" for t in column.slice(at, TEXTS_AT_ONCE).to_pylist()]
                arrays = codec.encode_packed(texts)
                fine = [codec.decode(ids.tolist()) == t for t, ids in zip(texts, arrays)] if check else []
                ends = np.cumsum([0] + [len(x) for x in arrays])
                flat = np.concatenate(arrays)
                in_bytes = np.concatenate([[0], np.cumsum(is_byte[flat])])
                out = [part.column(part.schema.get_field_index(c)) for c in keep]
                out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(np.diff(ends), pa.int64()), pa.array(in_bytes[ends[1:]] - in_bytes[ends[:-1]], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(fine, pa.bool_())] if check else []), names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, model: Unigram, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, text) of encoded rows; null or empty pieces give an empty text."""
    shared = Shipped(encoded.sparkSession, model)
    source = encoded.select(*keep, "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.load())
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(tidy(run), encoded.select(*keep).schema.add("text", "string"))
