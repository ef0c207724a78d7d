from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from monthpick.llm import embedding_graph, queries
from monthpick.llm.common import table


def brute(rows, threshold=0.95):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    ids, width = [i for i, _ in fine], max([len(v) for _, v in fine], default=1)
    x = np.array([np.pad(v / np.linalg.norm(v), (0, width - len(v))) for _, v in fine]).reshape(len(fine), -1)
    length = np.array([len(v) for _, v in fine])
    links = (x @ x.T >= threshold - 1e-12) & (length[:, None] == length) if len(fine) else np.zeros((0, 0), bool)
    np.fill_diagonal(links, False)
    label = list(ids)
    for _ in ids:
        new = [min([label[k], *[label[j] for j in np.flatnonzero(links[k])]]) for k in range(len(ids))]
        if new == label:
            break
        label = new
    out = {i: (0, i, True) for i, _ in rows}
    out.update({i: (int(links[k].sum()), label[k], label[k] == i) for k, i in enumerate(ids)})
    return out


def data(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5) for i, v in rows], "vec_id bigint, embedding array<float>, label int, shard string, m int")


def rows_of(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def fixture():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + rng.normal(0, 0.08 if k % 3 else 0.6, 8)).astype(np.float32).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(50)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (2005, [None] + [1.0] * 7), (2006, [1.0] * 3)]
    rows += [(3000 + k, [1.0, 2.0, 3.0 + (k > 2) * 0.1]) for k in range(6)] + [(3100 + k, [float(k % 2), 1.0, -1.0, 2.0]) for k in range(4)] + [(3200, [5.0]), (3201, [-5.0]), (3202, [7.0])]
    return rows


@pytest.mark.parametrize("part", [3000, 60])
def test_links_components_and_odd_vectors(spark, monkeypatch, part):
    monkeypatch.setattr(embedding_graph, "PART", part)
    monkeypatch.setattr(embedding_graph, "SHARD", 200)
    rows = fixture()
    assert rows_of(embedding_graph.link_embeddings(data(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert embedding_graph.link_embeddings(data(spark, [])).collect() == []


def test_recall_on_the_query_set(spark, sf):
    embeddings = table(spark, sf, "embeddings")
    found = embedding_graph.audit(embeddings, queries.op3_embedding_graph(spark, sf)).collect()
    assert found and all(r["found"] <= r["true"] for r in found)
    assert sum(r["found"] for r in found) >= 0.9 * sum(r["true"] for r in found)


def test_robust_pruning_keeps_the_nearest_and_drops_what_it_covers():
    x = embedding_graph.unit([[1, 0], [1, 0.01], [1, 0.02], [0, 1]])
    edges = embedding_graph.build_graph(x)
    assert edges[0, 0] == 1 and 2 not in edges[0].tolist()


def peak_mb(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_many_centroids_meet_a_block_of_rows_at_a_time():
    rng = np.random.default_rng(5)
    x, centroids = embedding_graph.unit(rng.normal(size=(10_000, 8))), embedding_graph.unit(rng.normal(size=(2_500, 8)))
    shards, peak = peak_mb(lambda: embedding_graph.nearest_shards(x, centroids))
    assert peak < 60  # 200 MB and more for all rows at once
    some = slice(0, 10_000, 500)
    assert np.array_equal(shards[some], np.sort(np.argsort(-(x[some] @ centroids.T), axis=1)[:, : embedding_graph.SPREAD], axis=1))
    fitted, peak = peak_mb(lambda: embedding_graph.fit_centroids(x, 1_250))
    assert fitted.shape == (1_250, 8) and peak < 60


def test_a_large_group_of_near_copies_is_searched_in_bounded_memory():
    rng = np.random.default_rng(6)
    x = embedding_graph.unit(rng.normal(size=(1, 8)) + rng.normal(0, 0.01, (1_200, 8)))
    edges = np.full((1_200, 1_199), -1, np.int32)  # one member lists all others
    edges[:, :24], edges[0] = embedding_graph.build_graph(x), np.arange(1, 1_200)
    found, peak = peak_mb(lambda: list(embedding_graph.search(x, edges, np.arange(4), x[:256], np.arange(256), 0.95)))
    assert peak < 150
    assert sum(len(i) for i, _ in found) == 256 * 1_200 and len({*zip(*(np.concatenate(z).tolist() for z in zip(*found)))}) == 256 * 1_200


def test_the_sample_is_the_rows_whose_ids_hash_lowest(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "MAX_SAMPLE", 40)
    ids = spark.range(2_000)
    want = [r[0] for r in ids.orderBy(embedding_graph.F.xxhash64("id"), "id").limit(40).collect()]
    assert [r[0] for r in embedding_graph._lowest(ids, 2_000).collect()] == want
