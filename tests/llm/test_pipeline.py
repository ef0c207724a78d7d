from __future__ import annotations

import re

import corpus_pipeline
from monthpick.llm import decontaminate, jaccard_join, private_data, toxicity
from monthpick.llm.common import Scratch, table


def test_each_stage_takes_effect_and_keeps_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    columns, scratch, seen = docs.columns, Scratch(spark, "test-pipeline"), []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.stage(stage(spark, docs, sf))
        seen.append((name, docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    ids = [{r.doc_id for r in out.select("doc_id").collect()} for _, _, out in seen]
    assert ids[0] >= ids[1] >= ids[2] and ids[2] == ids[3] == ids[4]
    _, first, clean = seen[0]
    model = toxicity.fit(first, table(spark, sf, "labels"))
    assert ids[0] == {r.doc_id for r in toxicity.score_toxicity(first, model).where("score < 0.7").collect()}
    classes = jaccard_join.jaccard_classes(clean).collect()
    assert ids[1] == {r.component_id for r in classes}
    copies = decontaminate.find_copies(seen[2][1], table(spark, sf, "benchmark")).collect()
    assert ids[2] == ids[1] - {r.doc_id for r in copies}
    before = {r.doc_id: r.text for r in seen[3][1].collect()}
    after = {r.doc_id: r.text for r in seen[3][2].collect()}
    spans = {r.doc_id: r.spans for r in private_data.find_private_data(seen[3][1]).collect()}
    assert all((before[i] == after[i]) == (not spans[i]) for i in before)
    assert not any(re.search(private_data.PATTERNS["phone"], t) and spans[i] == [] for i, t in before.items() if "+1 (" in t)
    assert docs.where("NOT round_trip").count() == 0


def test_run_is_the_chain_of_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "pieces", "n_pieces", "n_byte_pieces", "round_trip"]
    assert out.count() > 0


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing column names, empty side tables."""
    long = " ".join(f"word{i % 9973}" for i in range(60_000))
    copy = " ".join(f"c{i}" for i in range(40))
    item = " ".join(f"question{i} about{i}" for i in range(20))
    rows = [(1, copy, "en", "a"), (2, copy, None, None), (2, copy, None, None), (3, None, "en", "a"), (4, "", "en", "a"), (None, "no id", None, "b"), (None, None, None, None), (5, long, "en", "b"), (6, " \t\n", "en", "b")]
    rows += [(7, f"before {item} after", "en", "a"), (8, "mail me at someone@example.org today", "en", "a"), (9, "é 日本 \U0001f600", "de", "c"), (10, "one", "en", "a")]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id bigint, spans string, pieces int, kept boolean"
    docs = [(*r, None if r[1] is None else len(r[1]), 0.5, 1, "s", 2, True) for r in rows]
    spark.createDataFrame(docs, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 1), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    assert ids == sorted([1, 3, 4, 5, 6, 8, 9, 10, None, None], key=str)  # 2 is a copy of 1, 7 has a test item


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pieces_are_made_in_short_batches(spark, docs, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, encode = spark.conf.get(name), corpus_pipeline.sentencepieces.encode
    monkeypatch.setattr(corpus_pipeline.sentencepieces, "encode", lambda *a, **k: seen.append(spark.conf.get(name)) or encode(*a, **k))
    out = corpus_pipeline.encode_pieces(spark, docs([(k, f"text {k}") for k in range(1200)]), "")
    assert seen == [str(corpus_pipeline.sentencepieces.TEXTS_AT_ONCE)] and spark.conf.get(name) == before
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()  # no work is left for longer batches
    assert out.count() == 1200 and out.where("NOT round_trip").count() == 0
