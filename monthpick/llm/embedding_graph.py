"""Near-duplicate embeddings by a flat, robust-pruned proximity graph (operator 3).

Vectors go to the shards of their SPREAD nearest centroids, so shards overlap.  In
each shard a graph is built: a node's candidates are its nearest and some random
members, and robust pruning keeps those that no kept one is much nearer to.  The
adjacency lists that a vector has in its shards are united.  Searches run greedily from
medoids (and a vector's own node) over the united lists and, once in range, expand to everything in range.  Pairs
are verified by cosine in double precision.

A pair in several shards counts in the first of them.  Shards beyond a bound are dealt
into parts: each part has its own graph, and blocks of queries meet every part, so a
group of near copies that a third of all rows belong to is searched by many tasks.
Equal vectors are one node with a count.  ``audit`` measures recall against all rows.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite numbers link
with nothing and are their own component, as are vectors of another length than most;
repeated rows are equal vectors; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch, Shipped
from monthpick.llm.components import components

THRESHOLD = 0.95
#: Bound of the sample that the centroids are fitted on; every vector is indexed.
MAX_SAMPLE, SAMPLE_PER_CENTROID = 50_000, 8
SPREAD, SHARD, PART = 4, 1_000, 3_000
DEGREE, NEAREST, RANDOM, ALPHA = 24, 64, 32, 1.2
MEDOIDS, BEAM, HOPS, SLACK = 16, 24, 20, 0.06
QUERIES_AT_ONCE = 256
#: Numbers of a product of vectors, and pairs of a query and a neighbour, that a task holds at once.
CELLS, PAIRS = 1 << 20, 1 << 17
ROUNDS, SEED = 6, 3
QUERY_STEP = 20


def row_blocks(rows: int, width: int) -> Iterator[slice]:
    """Ranges of rows with at most ``CELLS`` numbers, if a row has ``width``."""
    step = max(1, CELLS // max(width, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(ROUNDS):
        home = np.concatenate([(sample[b] @ centroids.T).argmax(1) for b in row_blocks(len(sample), k)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    return centroids


def nearest_shards(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The SPREAD nearest centroids of each row, ascending."""
    k = min(SPREAD, len(centroids))
    return np.concatenate([np.sort(np.argpartition(-(x[b] @ centroids.T), k - 1, axis=1)[:, :k], axis=1) for b in row_blocks(len(x), len(centroids))])


def build_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency (nodes x DEGREE, -1 for none) by robust pruning of nearest and random candidates."""
    n = len(x)
    if n < 2:
        return np.full((n, DEGREE), -1, np.int32)
    rng = np.random.default_rng(n)
    near = min(NEAREST, n - 1)
    similar, nearest = np.empty((n, n), np.float32), np.empty((n, near), np.int64)
    for b in row_blocks(n, n):
        similar[b] = x[b] @ x.T
    np.fill_diagonal(similar, -2)
    for b in row_blocks(n, n):
        nearest[b] = np.argpartition(-similar[b], near - 1, axis=1)[:, :near]
    candidates = np.concatenate([nearest, rng.integers(0, n, (n, RANDOM))], axis=1)
    own = np.take_along_axis(similar, candidates, 1)
    order = np.argsort(-own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
    alive = own > -1.5
    out = np.full((n, DEGREE), -1, np.int32)
    rows = np.arange(n)
    np.fill_diagonal(similar, 1)
    for slot in range(DEGREE):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        chosen = candidates[rows, first]
        out[some, slot] = chosen[some]
        # a candidate goes if the chosen node is nearer to it than this node is, by the factor ALPHA
        alive &= ALPHA * (1 - similar[chosen[:, None], candidates]) > 1 - own
        alive[rows, first] = False
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """Members next to the centroids of some clusters of a shard."""
    k = min(MEDOIDS, len(x))
    return np.unique((x @ fit_centroids(x, k).T).argmax(0))


def search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs with cosine of at least the threshold, in blocks of queries.

    Searches start from the medoids and from the query's own node, if it has one here (``own``, else -1).
    """
    small = x.astype(np.float32)
    edges = np.concatenate([edges, np.full((1, edges.shape[1]), -1, edges.dtype)])
    at_once = max(1, min(QUERIES_AT_ONCE, PAIRS // edges.shape[1]))  # a node with many neighbours widens all of edges
    for at in range(0, len(queries), at_once):
        q64 = queries[at : at + at_once]
        q = q64.astype(np.float32)
        m, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((m, len(x) + 1), bool)
        seen[:, -1] = True  # the place of missing neighbours
        seen[:, starts] = True
        beam = np.broadcast_to(starts, (m, len(starts))).astype(np.int64)
        score = q @ small[starts].T
        fresh = np.ones(beam.shape, bool)
        self_node = own[at : at + at_once]
        other = (self_node >= 0) & ~seen[rows[:, 0], self_node]
        seen[rows[other, 0], self_node[other]] = True
        beam = np.concatenate([beam, np.maximum(self_node, 0)[:, None]], 1)
        score = np.concatenate([score, np.where(other, 1, -9)[:, None].astype(score.dtype)], 1)
        fresh = np.concatenate([fresh, other[:, None]], 1)
        near_q, near_node = np.nonzero(score >= threshold - SLACK)
        found = [(near_q, beam[near_q, near_node])]
        for _ in range(HOPS):
            pick = np.where(fresh, score, -9).argmax(1)
            active = fresh[rows[:, 0], pick]
            if not active.any():
                break
            fresh[rows[:, 0], pick] = False
            node = np.where(active, beam[rows[:, 0], pick], len(x))
            nb = edges[node].astype(np.int64)
            nb[nb < 0] = len(x)
            new = ~seen[rows, nb]
            seen[rows, nb] = True
            s = np.where(new, np.einsum("qd,qkd->qk", q, small[np.minimum(nb, len(x) - 1)]), -9)
            hit_q, hit = np.nonzero(s >= threshold - SLACK)
            found.append((hit_q, nb[hit_q, hit]))
            beam, score, fresh = np.concatenate([beam, nb], 1), np.concatenate([score, s], 1), np.concatenate([fresh, new], 1)
            if beam.shape[1] > BEAM:
                best = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
                beam, score, fresh = (np.take_along_axis(z, best, 1) for z in (beam, score, fresh))
        # the range grows from everything near: all its neighbours in range come in, until none is new
        wave = tuple(np.concatenate(z) for z in zip(*found))
        all_q, all_n = [wave[0]], [wave[1]]
        step = max(1, PAIRS // edges.shape[1])
        while len(wave[0]):
            new_q, new_n = [], []
            for i in range(0, len(wave[0]), step):
                nb = edges[wave[1][i : i + step]]
                k, slot = np.nonzero(nb >= 0)
                cq, cn = wave[0][i : i + step][k], nb[k, slot].astype(np.int64)
                keep = ~seen[cq, cn]
                code = np.unique(cq[keep] * (len(x) + 1) + cn[keep])
                cq, cn = code // (len(x) + 1), code % (len(x) + 1)
                seen[cq, cn] = True
                close = _dots(q, cq, small, cn) >= threshold - SLACK
                new_q.append(cq[close])
                new_n.append(cn[close])
            wave = np.concatenate(new_q), np.concatenate(new_n)
            all_q.append(wave[0])
            all_n.append(wave[1])
        pq, pn = np.concatenate(all_q), np.concatenate(all_n)
        for i in range(0, len(pq), PAIRS):
            cq, cn = pq[i : i + PAIRS], pn[i : i + PAIRS]
            exact = _dots(q64, cq, x, cn) >= threshold
            yield at + cq[exact], cn[exact]


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``i`` of ``a`` and ``j`` of ``b``."""
    step = max(1, CELLS // a.shape[1])
    return np.concatenate([np.einsum("kd,kd->k", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0, a.dtype)])


def _assigned(reps: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, m, vector, shards): the SPREAD nearest shards of each vector, ascending."""
    shared = Shipped(reps.sparkSession, centroids)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.load()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64())), pa.array(nearest_shards(x, centroids).tolist(), pa.list_(pa.int32()))], names=["id", "m", "vector", "shards"])

    return reps.select("id", "m", "embedding").mapInArrow(run, "id bigint, m bigint, vector array<double>, shards array<int>")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _lists(parts: DataFrame) -> DataFrame:
    """(id, neighbours) in each part of a shard."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        edges = build_graph(_matrix(table["vector"]))
        return pa.table({"id": ids, "near": pa.array([ids[e[e >= 0]] for e in edges], pa.list_(pa.int64()))})

    return parts.groupBy("shard", "part").applyInArrow(run, "id bigint, near array<bigint>")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its group) after joining the groups of a and b."""
    label = label.copy()
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    return label


def _search_parts(work: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links, root): partial link counts, and the least id of the group that the task's links put an id in."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        is_node = table["near"].is_valid().to_numpy()
        nodes, queries = table.filter(pa.array(is_node)), table.filter(pa.array(~is_node))
        if not nodes.num_rows or not queries.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        ids, x = nodes["id"].to_numpy(), _matrix(nodes["vector"])
        order = np.argsort(ids)
        near = nodes["near"].combine_chunks()
        sizes = np.diff(near.offsets.to_numpy())
        owner, other = np.repeat(np.arange(len(ids)), sizes), near.flatten().to_numpy()
        place = np.minimum(np.searchsorted(ids[order], other), len(ids) - 1)
        here = ids[order][place] == other  # united lists also have members of other shards
        owner, other = owner[here], order[place[here]]
        a, b = np.concatenate([owner, other]), np.concatenate([other, owner])
        code = np.unique(a * len(ids) + b)
        a, b = code // len(ids), code % len(ids)
        width = np.bincount(a, minlength=len(ids))
        edges = np.full((len(ids), max(int(width.max()), 1)), -1, np.int32)
        edges[a, np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)] = b
        q_ids, q = queries["id"].to_numpy(), _matrix(queries["vector"])
        node_shards, query_shards = _matrix(nodes["shards"]), _matrix(queries["shards"])
        m = nodes["m"].to_numpy()
        every = np.unique(np.concatenate([ids, q_ids]))
        links, label = np.zeros(len(every), np.int64), np.arange(len(every))
        at_query, at_node = np.searchsorted(every, q_ids), np.searchsorted(every, ids)
        spot = np.minimum(np.searchsorted(ids[order], q_ids), len(ids) - 1)
        own = np.where(ids[order][spot] == q_ids, order[spot], -1)
        for i, j in search(x, edges, medoids(x), q, own, threshold):
            i, j = i[q_ids[i] != ids[j]], j[q_ids[i] != ids[j]]
            label = _joined(label, at_query[i], at_node[j])
            # the pair counts in the first shard that both are in
            both = (query_shards[i][:, :, None] == node_shards[j][:, None, :]).any(2)
            first = np.where(both, query_shards[i], np.iinfo(np.int32).max).min(1)
            np.add.at(links, at_query[i[first == shard]], m[j[first == shard]])
        some = (label != np.arange(len(every))) | (links > 0)
        return pa.table({"id": every[some], "n_links": links[some], "root": every[label[some]]})

    return work.groupBy("shard", "part", "block").applyInArrow(run, "id bigint, n_links bigint, root bigint")


def _fine():
    vector = F.col("embedding")
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _valid(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_fine())


def link_embeddings(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; vectors of each length have a graph of their own."""
    scratch = Scratch(embeddings.sparkSession, "embedding-graph")
    valid = _valid(embeddings)
    every = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = every.where(~_fine()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    for (d,) in valid.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():  # one row for each length
        out = out.unionByName(_linked(valid.where(F.size("embedding") == d), threshold, scratch))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _lowest(groups: DataFrame, n: int) -> DataFrame:
    """The ``MAX_SAMPLE`` of ``n`` rows whose ids hash lowest; rows that hash far too high for that aren't sorted."""
    order = F.xxhash64("id")
    low = -(1 << 63) + int((1 << 64) * (2 * MAX_SAMPLE / n))
    if low < 1 << 62 and (some := groups.where(order <= low)).count() >= MAX_SAMPLE:
        groups = some
    return groups.orderBy(order, "id").limit(MAX_SAMPLE)


def _linked(valid: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(vec_id, n_links, component_id) of vectors of one length."""
    groups = scratch.stage(valid.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m")))
    n = groups.count()
    sample = unit(np.stack([np.array(r[0]) for r in _lowest(groups, n).select("embedding").toLocalIterator()]))
    k = int(min(max(1, -(-n * SPREAD // SHARD)), max(1, len(sample) // SAMPLE_PER_CENTROID)))
    assigned = scratch.stage(_assigned(groups, fit_centroids(sample, k)))
    members = assigned.select("*", F.explode("shards").alias("shard"))
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = members.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    lists = _lists(dealt.select("shard", "part", "id", "vector"))
    united = scratch.stage(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # at most SPREAD lists of DEGREE
    placed = dealt.join(united, "id").select("shard", "part", "parts", "id", "m", "vector", "shards", "near")
    every_other = F.sequence(F.lit(0), F.col("parts") - 1)
    nodes = placed.select("shard", "part", F.explode(every_other).alias("block"), "id", "m", "vector", "shards", "near")
    queries = dealt.select("shard", F.explode(every_other).alias("part"), F.col("part").alias("block"), "id", "m", "vector", "shards", F.lit(None).cast("array<bigint>").alias("near"))
    found = scratch.stage(_search_parts(nodes.unionByName(queries), threshold))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("linked"))
    roots = components(found.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    summary = scratch.stage(groups.join(counts, "id", "left").join(roots, "id", "left").select("embedding", (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    return valid.join(summary, "embedding").select("vec_id", "n_links", "component_id")


def audit(embeddings: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, found, true) of every vector whose id is divisible by QUERY_STEP: links found and links by brute force.

    The query set is compared with all rows, a block of queries at a time.
    """
    valid = _valid(embeddings)
    asked = valid.where(F.pmod("vec_id", F.lit(QUERY_STEP)) == 0)
    out = None
    for at in range(0, max(asked.count(), 1), 5_000):
        block = asked.orderBy("vec_id").offset(at).limit(5_000).toArrow()  # bounded
        if not block.num_rows:
            break
        shared = Shipped(embeddings.sparkSession, (block["vec_id"].to_numpy(), block["embedding"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.load()
            q = unit(vectors)
            for batch in batches:
                other, counts = batch.column(0).to_numpy(), np.zeros(len(q), np.int64)
                same = [len(v) == q.shape[1] for v in batch.column(1).to_pylist()]
                if any(same):
                    x = unit([v for v, s in zip(batch.column(1).to_pylist(), same) if s])
                    counts += ((q @ x.T >= threshold) & (ids[:, None] != other[same][None, :])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], names=["vec_id", "true"])

        part = valid.mapInArrow(run, "vec_id bigint, true bigint").groupBy("vec_id").agg(F.sum("true").alias("true"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id bigint, found bigint, true bigint")
    return out.join(links.select("vec_id", F.col("n_links").alias("found")), "vec_id").select("vec_id", "found", "true")
