from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from monthpick.llm import queries, substring_dedup
from monthpick.llm.common import table


def brute(rows):
    """doc_id -> set of possible (n_words, n_removed, digest)."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    big = float("inf")
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (big if i is None else i):
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_edge_cases_match_brute_force(spark, docs):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    noise = lambda n: " ".join(rng.choice("a b c d e".split()) for _ in range(n))
    rows = [(1, passage), (2, passage), (2, passage), (3, None), (4, ""), (5, " \t\n "), (6, "x " + passage + " y"), (7, " ".join(passage.split()[:12])), (8, " ".join(passage.split()[:13]))]
    rows += [(9, " ".join(passage.split()[20:]) + " tail"), (None, passage + " end"), (11, "é\x0bü z " * 20), (10, "é ü z " * 20), (12, passage.replace("p7", "q7"))]
    rows += [(20 + k, noise(rng.randint(0, 120))) for k in range(40)] + [(90, noise(30_000)), (91, noise(20_000))]
    df = substring_dedup.remove_repeats(docs(rows))
    assert got(df) == brute(rows)
    kept = {r.doc_id: r.kept for r in df.collect()}
    assert kept[6] == "x y" and kept[4] == ""


def test_rows_of_one_id_with_different_texts(spark, docs):
    w = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(1, w(0, 30)), (5, w(100, 130)), (5, w(0, 30) + " z"), (7, w(100, 130) + " y"), (5, w(100, 130)), (7, "a b " + w(0, 30)), (None, w(0, 20)), (None, w(100, 120) + " c")]
    out = substring_dedup.remove_repeats(docs(rows).repartition(5))
    assert got(out) == brute(rows)
    assert sorted((r.doc_id, r.n_removed) for r in out.collect() if r.doc_id is not None) == [(1, 0), (5, 0), (5, 0), (5, 30), (7, 30), (7, 30)]


def test_empty_table(docs):
    assert substring_dedup.remove_repeats(docs([])).collect() == []


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert got(queries.op1_substring_dedup(spark, sf)) == brute(rows)


@pytest.mark.parametrize("limit", [0, 3, 10**9])
def test_any_group_bound_gives_the_same_result(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(substring_dedup, "GROUP", limit)
    rng = random.Random(limit)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(60))) for k in range(12)]
    assert got(substring_dedup.remove_repeats(docs(rows))) == brute(rows)


def test_common_prefixes_are_counted_in_words():
    rows = np.zeros(5, substring_dedup._SUFFIX)
    rows["k0"] = [1 << 56 | 2 << 48, 1 << 56 | 2 << 48, 1 << 56 | 3 << 48, 1 << 56 | 3 << 48, 1 << 56 | 3 << 48]
    rows["k1"] = [5 << 24, 6 << 24, 6 << 24, 6 << 24, 6 << 24]
    rows["k2"] = [0, 0, 0, 0, 9]
    assert substring_dedup.common_prefixes(rows).tolist() == [0, 12, 1, 13, 12]


def test_symbols_of_windows_are_packed_by_fours():
    import numpy as np

    from monthpick.llm import substring_dedup as sd

    for n in (sd.WINDOW, 60):
        symbols = np.random.default_rng(n).integers(0, 256, n).astype(np.uint64)
        starts = np.arange(n - sd.WINDOW + 1)
        first, rest = sd._packed_symbols(symbols, starts)
        raw = [symbols[k : k + sd.WINDOW].astype(np.uint8).tobytes() for k in starts]
        assert first.tolist() == [int.from_bytes(x[:8], "big") for x in raw]
        assert rest.tolist() == [int.from_bytes(x[8:], "big") for x in raw]
