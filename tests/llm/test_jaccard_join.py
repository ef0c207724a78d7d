from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from monthpick.llm import jaccard_join, queries
from monthpick.llm.common import Scratch, table, word_memo
from monthpick.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("lists", [2, 16])
def test_groups_edges_and_odd_texts(docs, monkeypatch, lists):
    monkeypatch.setattr(jaccard_join, "LIST", lists)
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 300)}"
    base = [word() for _ in range(60)]
    rows = []
    for k in range(80):  # a chain of near copies with a common beginning
        mine = list(base)
        for _ in range(rng.randint(0, 3)):
            mine[rng.randrange(60)] = word()
        rows.append((k, " ".join(mine)))
    line = " ".join(f"common{k}" for k in range(9))
    rows += [(200 + k, line + " " + " ".join(word() for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows += [(300, None), (301, ""), (302, " \t"), (303, "A b"), (304, "a B"), (305, "a b c d"), (306, "a b c d e"), (307, "A B C D E"), (308, rows[0][1].upper()), (309, "é x"), (310, "É x")]
    rows += [(400 + k, " ".join(word() for _ in range(40))) for k in range(40)] + [(500, " ".join(word() for _ in range(20_000)))]
    assert got(jaccard_join.jaccard_classes(docs(rows))) == brute(rows)


def test_one_of_each_keeps_one_document_and_all_columns(docs):
    text = " ".join(f"x{k}" for k in range(30))
    source = docs([(5, text), (3, text + " y"), (3, text + " y"), (9, None), (10, ""), (None, "lonely"), (11, "other words here")])
    out = jaccard_join.one_of_each(source)
    assert out.columns == source.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["10", "11", "3", "9", "None"]


def test_empty_table(docs):
    assert jaccard_join.jaccard_classes(docs([])).collect() == []


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert got(queries.op9_jaccard_join(spark, sf)) == brute(rows)


def test_prefix_and_overlap_bounds():
    for n in range(1, 60):
        for m in range(1, 60):
            need = jaccard_join.needed_overlap(n, m)
            assert 100 * need >= 75 * (n + m - need) and (need == 0 or 100 * (need - 1) < 75 * (n + m - need + 1))
        assert n - jaccard_join.prefix_length(n) + 1 == -(-n * 3 // 4)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 600 + k) for k in range(100)] + [(7, 7)]
    scratch = Scratch(spark, "test")
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch).collect()}
    assert out == {k: 0 for k in range(101)} | {k: 500 for k in [500, *range(600, 700)]}


@pytest.mark.parametrize("at_once", [50, 1 << 22])
def test_frequent_shingles_are_counted_exactly_among_many_rare_ones(docs, monkeypatch, at_once):
    monkeypatch.setattr(jaccard_join, "COUNT_AT_ONCE", at_once)
    passages = {often: " ".join(f"p{often}x{k}" for k in range(7)) for often in (15, 16, 31, 32, 70)}
    texts = [f"{passage} " + " ".join(f"r{often}y{i}z{k}" for k in range(200)) for often, passage in passages.items() for i in range(often)]
    counted = jaccard_join._sets_and_counts(docs(list(enumerate(texts))), 64).where("slice IS NOT NULL")
    frequent = jaccard_join._frequent(counted, 64)
    whole = {often: jaccard_join.shingle_sets([passage.encode()], word_memo())[0] for often, passage in passages.items()}
    assert {often: set(jaccard_join._classes(x, frequent).tolist()) for often, x in whole.items()} == {15: {0}, 16: {1}, 31: {1}, 32: {2}, 70: {3}}
    assert len(frequent[0]) == 3 * 4 and (np.diff(frequent[0].astype(np.int64)) > 0).all()
    monkeypatch.setattr(jaccard_join, "FREQUENT", 64)  # one of each slice: the most frequent
    few = jaccard_join._frequent(counted, 64)
    assert 0 < len(few[0]) <= 12 and set(jaccard_join._classes(whole[70], few).tolist()) - {0} == {3}
