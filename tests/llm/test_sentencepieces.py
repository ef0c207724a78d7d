from __future__ import annotations

import os

import pytest

from monthpick.llm import queries, sentencepieces
from monthpick.llm.common import table

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepieces.DEFAULT_MODEL), reason="tokenizer files absent")
TEXTS = [None, "", " ", "  a  b ", "▁ ▁▁x", "日本語 \U0001f600\n\n\tq", "word, word. x=1.5;  ###", "aaaa" * 400, "é" * 3000, " " * 1000, "the of " * 2000]


@pytest.fixture(scope="module")
def model():
    return sentencepieces.load_model()


def best_score(model, pieces, text):
    """Highest score sum over all segmentations, by dynamic programming over plain strings."""
    best = [0.0] + [None] * len(text)
    for j in range(1, len(text) + 1):
        options = []
        for i in range(max(0, j - 16), j):
            part = text[i:j]
            name = None if "▁" in part else part.replace(" ", "▁")
            if name in pieces:
                options.append(best[i] + model.scores[pieces[name]])
            elif j == i + 1:
                options.append(best[i] + model.unknown)
        best[j] = max(options)
    return best[-1]


def test_viterbi_finds_the_best_score(model):
    pieces = {p: i for i, (p, _, kind) in enumerate(sentencepieces.read_pieces(sentencepieces.DEFAULT_MODEL)) if kind == 1}
    codec = sentencepieces.Codec(model)
    in_bytes = set(model.byte_ids)
    for text in [t for t in TEXTS if t and len(t) < 100] + ["Hello wörld, the end of xylophones", "naïve café 1234 zzzzqqq"]:
        ids = codec.encode(text)
        unknown = sum(text_char not in model.codes or (text_char != " " and text_char not in pieces) for text_char in text)
        score = sum(model.scores[i] for i in ids if i not in in_bytes) + model.unknown * (unknown if any(i in in_bytes for i in ids) else 0)
        assert score == pytest.approx(best_score(model, pieces, " " + text))


def test_many_parts_at_once_equal_one_by_one(model):
    parts = [" the", " word", "ing", " \U0001f600a", "x▁y", " " * 5 + "abc"] * 3 + [f" w{k}ord" for k in range(50)]
    assert model.solve_many(parts) == [model.solve(p) for p in parts]


def test_round_trip_and_extra_columns(spark, docs, model):
    source = docs(list(enumerate(TEXTS)) + [(1, "")], more="pieces string, n_pieces int")
    encoded = sentencepieces.encode(source, model, keep=("doc_id", "lang"), check=True)
    rows = encoded.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.round_trip for r in rows)
    assert {r.doc_id: r.text for r in sentencepieces.decode(encoded, model).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert all(r.n_pieces == len(r.pieces) for r in rows)


def test_empty_table(docs, model):
    assert sentencepieces.encode(docs([]), model).collect() == []


def test_query_round_trips_every_document(spark, sf):
    out = queries.op4_sentencepiece(spark, sf)
    assert out.count() == table(spark, sf, "documents").count()
    assert out.where("NOT round_trip").count() == 0


def test_memo_is_small_and_gives_the_same_ids(model):
    """A full memo takes less than 300 bytes a part, and packed ids are those of each part solved alone."""
    import tracemalloc

    codec = sentencepieces.Codec(model)
    texts = [" ".join(f"part{a}of{b}words" for b in range(100)) for a in range(400)]
    codec.encode_many(["warm up"])
    tracemalloc.start()
    for at in range(0, len(texts), 50):
        codec.encode_many(texts[at : at + 50])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held / len(codec.memo) < 300
    for text in [t or "" for t in TEXTS] + texts[:2]:
        parts = codec.parts(" " + text) if text else []
        assert codec.encode(text) == [i for p in parts for i in model.solve(p)]
