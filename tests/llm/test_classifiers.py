from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from monthpick.llm import common, language_id, queries, toxicity
from monthpick.llm.common import Memo, table

MID = "/root/testdata/sf0.1"


def test_held_out_fold_is_crc32_of_the_id(spark, sf):
    for q in (queries.op5_toxicity, queries.op8_language_id):
        rows = q(spark, sf).collect()
        assert rows and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_finds_held_out_toxic_documents(spark, sf):
    rows = queries.op5_toxicity(spark, MID).join(table(spark, MID, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    # a part of the table's junk documents has the label without any sign of it in the text
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_language_of_held_out_documents(spark, sf):
    rows = queries.op8_language_id(spark, MID).join(table(spark, MID, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    kept = [r for r in rows if not r.rejected]
    assert np.mean([r.lang == r.lang_pred for r in kept]) >= 0.98


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(words, 30)) + (" nasty you" if k % 4 == 0 else "") for k in range(400)]
    return toxicity.train([t.encode() for t in texts], [int(k % 4 == 0) for k in range(400)])


def test_toxicity_edge_cases(docs, small_model):
    source = docs([(1, None), (2, ""), (3, "nasty"), (3, "nasty"), (None, "w1 w2"), (5, "w1 " * 50_000 + "nasty you")])
    got = {}
    for r in toxicity.score_toxicity(source.drop("score"), small_model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert got[1] == got[2] and got[1][0] < 0.7
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    assert got[5][0] >= 0.7 > got[None][0]
    assert toxicity.score_toxicity(docs([]), small_model).collect() == []


def test_filters_do_not_reach_into_the_next_text(small_model):
    memo = Memo(small_model.packed)
    texts = [b"w1 w2", b"nasty you", b"w3", b""]
    together = toxicity.score_texts(small_model, texts, memo)
    alone = [toxicity.score_texts(small_model, [t], memo)[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-6)


def test_no_labels_gives_no_model(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    source = docs([(1, "a"), (2, None)])
    model = toxicity.fit(source, labels)
    assert model is None
    assert [r.score for r in toxicity.score_toxicity(source.drop("score"), model).collect()] == [0.0, 0.0]


def test_contradicting_and_held_out_labels_are_not_learned(spark, docs):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1][:40]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids] + [(1000, 1, 0), (1000, 1, 1), (1001, 1, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(docs([(i, "x y") for i in [*ids, 1000, 1001]]), labels) is None


def test_thresholds_follow_the_class_shares_of_all_labels(spark, docs):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(200)]
    # the sign is in each toxic text and in a tenth of the clean ones, which are 30 times as many
    kind = [k % 31 == 0 for k in range(6200)]
    rows = [(k, " ".join(rng.choice(words, 12)) + (" maybe" if toxic or rng.random() < 0.1 else "") + (" nasty" if toxic and rng.random() < 0.6 else "")) for k, toxic in enumerate(kind)]
    labels = spark.createDataFrame([(k, 1, int(t)) for k, t in enumerate(kind)], "doc_id bigint, quality int, toxic int")
    source = docs(rows)

    def predicted(model):
        got = toxicity.score_toxicity(source.drop("score"), model).collect()
        return {r.doc_id for r in got if r.score >= toxicity.CUT}

    small, whole = (predicted(toxicity.fit(source, labels, max_toxic=100, max_clean=n)) for n in (120, 6200))
    clean = [k for k, t in enumerate(kind) if not t]
    # a sample of one clean row to each toxic one must not drop the clean rows with the sign
    assert len(small.intersection(clean)) <= 0.02 * len(clean) and len(whole.intersection(clean)) <= 0.02 * len(clean)
    assert sum(k in small for k, t in enumerate(kind) if t) >= 0.4 * sum(kind)


def test_language_edge_cases(spark, docs):
    source = docs([(k, "the cat and the dog " * 3) for k in range(30)] + [(100, None), (101, ""), (102, "123 !? ²"), (103, "the dog"), (104, "日"), (105, "the " * 40_000)])
    model = language_id.fit(source)
    got = {r.doc_id: r for r in language_id.identify(source, model).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102, 103, 104, 105)] == ["und", "und", "und", "en", "en", "en"]
    assert got[100].score == 0 and got[100].rejected
    assert language_id.identify(docs([]), model).collect() == []
    none = language_id.fit(source.withColumn("lang", source["code"]))
    assert none is None and {r.lang_pred for r in language_id.identify(source, none).collect()} == {"und"}


def test_texts_come_in_blocks_and_the_fit_takes_few_rows_at_once(spark, docs, monkeypatch):
    texts = ["aa bb", None, "", "é" * 40, "cc", "dd " * 30, None]
    batch = pa.RecordBatch.from_pydict({"text": texts}).slice(1)
    got = list(common.text_blocks(batch, "text", 50))
    assert [t for block in got for t in block] == [(t or "").encode() for t in texts[1:]] and len(got) > 2
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, calibrate = spark.conf.get(name), toxicity._calibrate
    monkeypatch.setattr(toxicity, "_calibrate", lambda *a: seen.append(spark.conf.get(name)) or calibrate(*a))
    source = docs([(k, f"word{k % 7} other{k % 5}" + (" nasty" if k % 3 == 0 else "")) for k in range(200)])
    assert toxicity.fit(source, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id bigint, toxic int"))
    assert seen == [str(toxicity.FIT_ROWS)] and spark.conf.get(name) == before
