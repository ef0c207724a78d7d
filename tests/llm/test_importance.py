"""Importance resampling against brute force over words, windows and sorted scores."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from monthpick.llm import importance
from monthpick.llm.common import table
from monthpick.llm.queries import op12_importance


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)}
    rows = []
    for i, x in docs:
        words, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_whole_query(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in table(spark, sf, "benchmark").select("text").collect()]
    assert got(op12_importance(spark, sf)) == brute(docs, target)


def test_odd_rows(spark, docs):
    words = " ".join(f"w{i % 37}" for i in range(25))
    rows = [(1, None), (2, ""), (3, "ÀB  c\x00d9`E"), (None, words), (4, words), (4, words + " more"), (5, "x" * 50), (5, words)]
    rows += [(100 + i, f"{words} {i} Ünï—code") for i in range(60)]
    target = ["w1 w2 w3 w4", None, ""]
    df = importance.resample(docs(rows, "weight double, rank string, score int, buckets int"), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"))
    assert got(df) == brute(rows, target)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs([]), none).count() == 0
    assert got(importance.resample(docs([(1, "a b")]), none)) == brute([(1, "a b")], [])


@pytest.mark.parametrize("size", [1, 7, 50])
def test_pieces_have_windows_across_cuts(monkeypatch, size):
    text = "Ab c, defg 12 h  i-j " * 9 + "z" * 60
    split = importance.pre_tokenizer().pre_tokenize_str
    monkeypatch.setattr(importance.text_pieces, "__defaults__", (size,))
    n, buckets = importance.feature_buckets(text, split)
    words, want = features(text)
    assert n == len(words) and sorted(buckets.tolist()) == sorted(want)


def test_very_long_text(spark, docs):
    long = " ".join(f"w{i % 911}" for i in range(300_000))
    rows = [(1, long), (2, "a" * 1_000_000)]
    assert got(importance.resample(docs(rows), spark.createDataFrame([("w1 w2",)], "text string"))) == brute(rows, ["w1 w2"])
