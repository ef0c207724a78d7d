from __future__ import annotations

import random

import numpy as np

from monthpick.llm import decontaminate, queries
from monthpick.llm.common import table
from monthpick.llm.toxicity import text_words

ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


def smith_waterman(x, y):
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x[i - 1] == y[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_textbook_matrix():
    rng = random.Random(1)
    pairs = [(np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 15))], np.int32), np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 25))], np.int32)) for _ in range(60)]
    assert decontaminate.align(pairs)[:, 0].tolist() == [smith_waterman(x.tolist(), y.tolist()) for x, y in pairs]


def test_edited_copies_are_found_and_clean_texts_are_not(spark, docs):
    words = ITEM.split()
    noise = " ".join(f"n{k % 97}" for k in range(3000))
    edited = " ".join(w if k % 6 else "changed" for k, w in enumerate(words))
    shorter = " ".join(w for k, w in enumerate(words) if k not in (5, 11))
    rows = [(1, f"{noise} {ITEM.upper()} {noise}"), (2, f"start {edited} end"), (3, noise), (4, None), (5, ""), (6, f"x {shorter} y"), (7, ITEM), (7, ITEM), (8, " ".join(words[:4]))]
    items = spark.createDataFrame([(10, ITEM, "z"), (11, None, "z"), (12, "", "z"), (13, "only two", "z"), (14, ITEM, "z")], "item_id bigint, text string, doc_id string")
    source = docs(rows)
    got = decontaminate.find_copies(source, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 2, 6, 7) for i in (10, 14)}
    assert sum(r.doc_id == 7 for r in got) == 4
    one = next(r for r in got if r.doc_id == 1)
    assert (one.score, one.first_word, one.last_word, one.n_matched) == (1.0, 3000, 3000 + len(words) - 1, len(words))
    left = decontaminate.drop_copies(source, items)
    assert left.columns == source.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 8]


def test_blocks_of_items_give_the_same_rows(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, f"i{k}a i{k}b i{k}c i{k}d i{k}e") for k in range(9)], "item_id bigint, text string")
    source = docs([(k, f"x i{k}a i{k}b i{k}c i{k}d i{k}e y") for k in range(9)])
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_copies(source, items).collect()) == [(k, k) for k in range(9)]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_copies(docs([(1, "a b c d")]), none).collect() == []
    assert decontaminate.find_copies(docs([]), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")).collect() == []


def test_query_against_whole_matrices(spark, sf):
    documents = table(spark, sf, "documents").where("length(text) < 4000").select("doc_id", "text").collect()
    items = {r.item_id: text_words(r.text.encode()) for r in table(spark, sf, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, sf).collect()}
    for r in documents:
        words = text_words((r.text or "").encode())
        for i, item in items.items():
            # copies share long runs with their item; brute force wherever a tenth of the words agree
            if len(set(words) & set(item)) * 10 >= 3 * len(set(item)):
                assert ((r.doc_id, i) in got) == (smith_waterman(item, words) / (2 * len(item)) >= decontaminate.MIN_SCORE)


def test_copied_parts_count_by_their_own_strength(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = {10: text(59), 11: text(38), 12: text(400)}
    changed = items[10][20:42]
    changed[11] = "other"
    parts = {1: (10, items[10][5:25]), 2: (11, items[11][20:33]), 3: (12, items[12][100:250]), 4: (10, changed)}
    short = {5: items[10][5:15], 6: items[12][0:24:2]}
    rows = [(d, " ".join(text(200) + x + text(200))) for d, x in [*((d, x) for d, (_, x) in parts.items()), *short.items(), (7, [])]]
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id bigint, text string")
    source = docs(rows)
    got = decontaminate.find_copies(source, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, k) for d, (k, _) in parts.items()}
    assert all(r.score < decontaminate.MIN_SCORE for r in got)
    assert sorted(r.doc_id for r in decontaminate.drop_copies(source, benchmark).collect()) == [5, 6, 7]
