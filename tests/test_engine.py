"""Operators of the clustering engine: known values, brute force, and invariance."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import coarsening, fuzzy, labelprop, search, sparse, tree
from tessera.operators.components import connected_components
from tessera.operators.embedding import Block, node_embedding
from tessera.operators.knn import knn, nested
from tessera.operators.mst import core_distance, grow_tree, linkage, merge_edges, mst, nearest_other_component
from tessera.params import ClusterParams, EmbeddingParams, NearestNeighbourParams, Verbosity, parse_gpu_method, parse_method, parse_verbosity, resolve_method
from tessera.sources.blobs import blob_arrays, make_blobs
from tessera.sources.vectors import precomputed_knn, read_vectors, write_result


def points(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in p]) for i, p in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()))


def coo(spark, data, names="i, j, v"):
    a, b, c = names.split(", ")
    return spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in data], f"{a} long, {b} long, {c} double")


# --- parameters -----------------------------------------------------------------------------------


def test_names_and_defaults():
    assert parse_method("KmKNN") == "kmknn" and parse_method("x") is None
    assert parse_gpu_method("IVF_gpu") == parse_gpu_method("ivf") == "ivf" and parse_gpu_method("hnsw") is None
    assert resolve_method("nonsense") == "kmknn" and resolve_method("nonsense_gpu") == "ivf" and resolve_method("HNSW") == "hnsw"
    assert [parse_verbosity(k) for k in (0, 1, 2, 7)] == [Verbosity.QUIET, Verbosity.NORMAL, Verbosity.DETAILED, Verbosity.QUIET]
    assert parse_verbosity(2).normal and parse_verbosity(2).detailed and not parse_verbosity(1).detailed
    assert [ClusterParams(n_neighbours=k).dim for k in (4, 15, 40, 100)] == [4, 4, 10, 16]
    filled = NearestNeighbourParams().filled(15)
    assert (filled.k, filled.k_build, filled.beam_width, filled.max_beam_iters) == (15, 30, 60, 180)


# --- neighbours -----------------------------------------------------------------------------------


def slow_knn(ids, x, k, metric="euclidean"):
    out = []
    for i, a in zip(ids, x):
        near = []
        for j, b in zip(ids, x):
            if i != j:
                na, nb = math.sqrt(sum(v * v for v in a)), math.sqrt(sum(v * v for v in b))
                d = math.dist(a, b) if metric == "euclidean" else (1 - sum(p * q for p, q in zip(a, b)) / (na * nb) if na * nb > 0 else 1.0)
                near.append((round(d, 9), j))
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.mark.parametrize("method", ["exhaustive", "kmknn", "exhaustive_gpu"])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_exact_search_with_copies_and_zero_vectors(spark, method, metric):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-3, 4, (40, 3)).astype(float), np.zeros((2, 3)), np.ones((6, 3))])
    ids = [int(i) for i in rng.permutation(900)[: len(x)]]
    for block in (1 << 20, 400):  # one block, many blocks
        got = [(a, b, c, round(d, 9)) for a, b, c, d in rows(knn(points(spark, x, ids).repartition(3), 5, method, metric, block_bytes=block))]
        want = slow_knn(ids, x.tolist(), 5, metric)
        if metric == "euclidean":
            assert got == want
        else:  # equal similarities differ in their last bits
            assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want]
            assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)


@pytest.mark.parametrize(("method", "least"), [("ivf", 0.7), ("annoy", 0.9), ("hnsw", 0.9), ("nndescent", 0.9), ("balltree", 0.7)])
def test_recall_on_blobs(spark, method, least):
    x, _ = blob_arrays(60, 5, 8, 12, 1.0, 42)
    df = points(spark, x)
    exact = {(a, c) for a, _, c, _ in rows(knn(df, 10, "exhaustive"))}
    got = rows(knn(df, 10, method))
    assert len({(a, c) for a, _, c, _ in got} & exact) / len(exact) >= least
    assert all(a != c for a, _, c, _ in got) and max(b for _, b, _, _ in got) <= 10
    assert rows(knn(df.repartition(5), 10, method)) == got


@pytest.mark.parametrize("method", ["ivf", "annoy", "hnsw", "nndescent", "balltree"])
def test_full_budget_is_exact_and_proposes_few_rows(method):
    """Also where groups are far apart, or copies of one vector; what is held grows with k, not with the block."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((150, 4)), 50 + rng.random((40, 4)), np.ones((60, 4)) * -9])
    full = NearestNeighbourParams(n_probes=1 << 20, search_budget=1 << 40, bt_budget=1.0, ef_search=1 << 20, ef_budget=1 << 20)
    at, row = search.INDEXES[method](x, full, 42, 6).query(x[:190], 6)
    assert len(at) <= 190 * 8
    want = np.argsort(((x[:190, None] - x[None]) ** 2).sum(2), axis=1, kind="stable")[:, :6]
    assert {(i, int(j)) for i, w in enumerate(want) for j in w} <= set(zip(at.tolist(), row.tolist(), strict=True))


@pytest.mark.parametrize("method", ["ivf", "annoy", "balltree"])
def test_budgets_are_raised_until_neighbours_are_found(method):
    """Without clusters the reference's budgets see too little."""
    x = np.random.default_rng(9).normal(size=(1500, 24))
    share = []
    for least in (0.9, 0):
        at, row = search.INDEXES[method](x, NearestNeighbourParams(least_recall=least, n_tree=10), 42, 11).query(x[:300], 11)
        d = ((x[:300, None] - x[None]) ** 2).sum(2)
        want = {(i, int(j)) for i, w in enumerate(np.argsort(d, axis=1)[:, 1:11]) for j in w}
        share.append(len(want & set(zip(at.tolist(), row.tolist(), strict=True))) / len(want))
    assert share[0] >= 0.9 > share[1]


@pytest.mark.parametrize("offset", [0, 1e4])
def test_forest_answers_queries_together(monkeypatch, offset):
    """No walk of a query's own; alone or together, each gets the same rows, copies and far origins too, and enough of its neighbours."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 12)), np.zeros((60, 12))]) + offset
    x[500:520] = x[499]
    monkeypatch.setattr(search.heapq, "heappop", None)
    index = search.Forest(x, NearestNeighbourParams(), 42, 6)
    assert index.budget < index.enough() / 4
    ask = np.arange(0, 3060, 9)
    at, row = index.query(x[ask], 6)
    assert len(np.unique(at * len(x) + row)) == len(at)
    d = ((x[None] - x[ask][:, None]) ** 2).sum(2)
    near = np.argsort(d, axis=1, kind="stable")[:, :6]
    assert np.mean([np.isin(near[i], row[at == i]).mean() for i in range(len(ask))]) > 0.9
    assert index.query(x[:0], 6)[0].size == 0
    for i in range(0, len(ask), 40):
        assert set(index.query(x[ask[i : i + 1]], 6)[1]) == set(row[at == i])


def test_centres_hold_no_whole_table_of_distances(monkeypatch):
    """Rows x centres are made in pieces."""
    seen, real = [], search.squared
    monkeypatch.setattr(search, "PAIRS", 5000)
    monkeypatch.setattr(search, "squared", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    search.BallTree(np.random.default_rng(1).random((1000, 3)), NearestNeighbourParams(least_recall=0), 42, 5)
    assert max(seen) <= 5000


def test_search_edge_cases(spark):
    one = points(spark, [[1.0, 2.0]])
    assert knn(one, 3).count() == 0 and knn(one.limit(0), 3).count() == 0
    two = points(spark, [[0.0], [3.0]])
    for method in search.INDEXES:
        assert rows(knn(two, 5, method)) == [(0, 1, 1, 3.0), (1, 1, 0, 3.0)]
    with pytest.raises(ValueError):
        knn(two, 1, metric="manhattan")
    with pytest.raises(ValueError):
        knn(two, 0)
    with pytest.raises(ValueError):
        knn(two.unionByName(points(spark, [[1.0, 2.0]], [9])), 1)
    lists = nested(knn(points(spark, [[0.0], [1.0], [3.0]]), 2)).orderBy("src").collect()
    assert [(r.indices, r.distances) for r in lists] == [([1, 2], [1.0, 3.0]), ([0, 2], [1.0, 2.0]), ([1, 0], [2.0, 3.0])]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0], 0), (3, None, 0)], "vec_id int, embedding array<float>, label int")
    df.write.orc(str(tmp_path / "v"))
    read = read_vectors(spark, str(tmp_path / "v"), fmt="orc")
    assert rows(read) == [(1, [1.0, 2.0])] and dict(read.dtypes) == {"id": "bigint", "embedding": "array<double>"}
    near = coo(spark, [(0, 1, 1), (0, 2, 0.5), (1, 0, 1)], "src, dst, dist")
    assert rows(precomputed_knn(near)) == [(0, 1, 2, 0.5), (0, 2, 1, 1.0), (1, 1, 0, 1.0)]
    for bad in ([(0, 0, 1)], [(0, 1, -1)], [(0, 1, 1), (0, 1, 2)], [(0, 1, float("nan"))]):
        with pytest.raises(ValueError):
            precomputed_knn(coo(spark, bad, "src, dst, dist"))
    with pytest.raises(ValueError):
        precomputed_knn(near.drop("dist"))
    write_result({"knn": near}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/knn")).count() == 3


# --- fuzzy graph ----------------------------------------------------------------------------------


def near_table(spark, lists):
    return spark.createDataFrame([(i, r + 1, 100 + r, float(d)) for i, l in enumerate(lists) for r, d in enumerate(l)], "src long, rank int, dst long, dist double")


def test_bandwidths(spark):
    got = {r.src: r for r in fuzzy.smooth_knn_dist(near_table(spark, [[1, 2], [1.5, 3], [0.5, 1.5]]), 2).collect()}
    assert [got[i].rho for i in range(3)] == [1.0, 1.5, 0.5] and all(r.sigma > 0 for r in got.values())
    rng = np.random.default_rng(1)
    lists = np.sort(rng.random((20, 8)), axis=1)
    for r in fuzzy.smooth_knn_dist(near_table(spark, lists), 8).collect():
        assert abs(np.exp(-np.maximum(lists[r.src] - r.rho, 0) / r.sigma).sum() - 3) < 1e-4
    tied = fuzzy.smooth_knn_dist(near_table(spark, [[0.0] * 8]), 8).first()
    assert tied.sigma == 2.0**-64 and tied.rho == 0
    frac = {r.src: r.rho for r in fuzzy.smooth_knn_dist(near_table(spark, [[1, 2, 4]]), 3, 1.5).collect()}
    assert frac[0] == 1.5
    assert fuzzy.smooth_knn_dist(near_table(spark, [[1, 2]]), 2, 0).first().rho == 0


def test_symmetrise_and_adjacency(spark):
    both = rows(fuzzy.symmetrise(coo(spark, [(0, 1, 0.8), (1, 0, 0.6)], "src, dst, w")))
    assert [(a, b, round(w, 9)) for a, b, w in both] == [(0, 1, 0.92), (1, 0, 0.92)]
    assert rows(fuzzy.symmetrise(coo(spark, [(0, 1, 0.7), (2, 3, 0.0)], "src, dst, w"))) == [(0, 1, 0.7), (1, 0, 0.7)]
    lists = {r.id: r.adj for r in fuzzy.adjacency_list(coo(spark, [(0, 2, 0.5), (0, 1, 0.7)], "src, dst, w"), spark.range(3)).collect()}
    assert [tuple(e) for e in lists[0]] == [(1, 0.7), (2, 0.5)] and lists[1] == lists[2] == []
    near = knn(points(spark, [[1.0, 1.0]] * 10), 4)
    w = [r.w for r in fuzzy.fuzzy_simplicial_set(near, 4).collect()]
    assert len(w) >= 40 and all(math.isfinite(v) and v >= 0 for v in w)
    assert fuzzy.fuzzy_simplicial_set(near.limit(0), 4).count() == 0
    assert fuzzy.fuzzy_simplicial_set(near, 4, symmetric=False).count() == 40


def test_edges_within_blobs_are_heavier(spark):
    b = make_blobs(spark, 40, 2, 4, 30, 0.5)
    e = fuzzy.fuzzy_simplicial_set(knn(b.select("id", "embedding"), 15), 15).collect()
    inside, across = ([r.w for r in e if (r.src < 40) == (r.dst < 40) is want] for want in (True, False))
    assert np.mean(inside) > (np.mean(across) if across else 0)


# --- sparse algebra -------------------------------------------------------------------------------

A = [(0, 0, 1), (0, 2, 2), (1, 1, 3), (2, 0, 4), (2, 2, 5)]


def test_sparse_algebra_by_hand(spark):
    a = coo(spark, A)
    dense = lambda df: {(i, j): round(v, 9) for i, j, v in rows(df)}
    assert dense(sparse.matmul(a, sparse.transpose(a))) == {(0, 0): 5, (0, 2): 14, (1, 1): 9, (2, 0): 14, (2, 2): 41}
    assert dense(sparse.hadamard(a, sparse.transpose(a))) == {(0, 0): 1, (0, 2): 8, (1, 1): 9, (2, 0): 8, (2, 2): 25}
    assert dense(sparse.from_coo(coo(spark, [*A, (0, 0, 2)])))[0, 0] == 3 and sparse.nnz(a) == 5
    assert dense(sparse.clip(a, 2, 4)) == {(0, 0): 2, (0, 2): 2, (1, 1): 3, (2, 0): 4, (2, 2): 4}
    assert dense(sparse.normalise_rows_l1(coo(spark, [(0, 0, -1), (0, 1, 3), (1, 0, 0)]))) == {(0, 0): -0.25, (0, 1): 0.75, (1, 0): 0}
    assert dense(sparse.normalise_cols_l2(coo(spark, [(0, 0, 3), (1, 0, 4), (1, 1, 0)]))) == {(0, 0): 0.6, (1, 0): 0.8, (1, 1): 0}
    wide = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, pos array<double>")
    assert rows(sparse.matmul_dense(a, wide)) == [(0, [3.0, 2.0]), (1, [0.0, 3.0]), (2, [9.0, 5.0])]
    assert rows(sparse.to_dense(a, 3)) == [(0, [1.0, 0.0, 2.0]), (1, [0.0, 3.0, 0.0]), (2, [4.0, 0.0, 5.0])]
    assert rows(sparse.from_dense(sparse.to_dense(a, 3)).where("v <> 0")) == sorted((i, j, float(v)) for i, j, v in A)
    assert rows(sparse.partition_indicator(spark.createDataFrame([(5, 1)], "id long, label long"))) == [(5, 1, 1.0)]
    assert [tuple(e) for e in rows(sparse.to_adjacency_list(a))[2][1]] == [(0, 4.0), (2, 5.0)]


# --- label propagation ----------------------------------------------------------------------------


def labels_of(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, label long")


def test_one_round(spark):
    e = coo(spark, [(0, 1, 2.0), (0, 2, 0.3), (3, 1, 0.5), (4, 1, 1.0), (5, 1, 1.0), (5, 2, 1.0), (6, 7, 9.0)], "src, dst, w")
    got = dict(rows(labelprop.label_prop_iteration(e, labels_of(spark, [-1, 5, 7, -1, -1, -1, 2, -1]))))
    assert got == {0: 5, 1: 5, 2: 7, 3: -1, 4: 5, 5: 7, 6: 2, 7: -1}


def test_remap_and_outliers(spark):
    assert dict(rows(labelprop.remap_labels(labels_of(spark, [10, 10, 20, 20, 10])))) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0}
    assert dict(rows(labelprop.remap_labels(labels_of(spark, [5, -1, 5, -1])))) == {0: 0, 1: 1, 2: 0, 3: 2}
    path = [(i, i + 1, 1.0) for i in range(5)] + [(i + 1, i, 1.0) for i in range(5)]
    got = dict(rows(labelprop.label_outliers(coo(spark, path, "src, dst, w"), labels_of(spark, [3, -1, -1, -1, -1, 1, -1]), seed=4)))
    assert [got[i] for i in range(6)] == [3, 3, 3, 1, 1, 1] and 0 <= got[6] <= 3
    none = labels_of(spark, [-1, -1])
    assert rows(labelprop.label_outliers(coo(spark, path, "src, dst, w"), none)) == rows(none)


def test_both_ways_give_one_partition_and_layout(spark):
    b = make_blobs(spark, 40, 3, 6, 20, 1.0)
    p = b.select("id", "embedding")
    g = fuzzy.fuzzy_simplicial_set(knn(p, 10), 10).cache()
    a, c = (rows(labelprop.label_prop_partition(g, p, 20, one_task_rows=n)) for n in (1 << 14, 0))
    assert a == c and {v for _, v in a} <= set(range(20))
    assert len({v for _, v in rows(labelprop.label_prop_partition(g, p, 0))}) == 120
    pos = p.withColumnRenamed("embedding", "pos")
    x, y = (np.array([r.pos for r in labelprop.label_prop_init(g, pos, 4, EmbeddingParams(n_epochs=6), one_task_rows=n).orderBy("id").collect()]) for n in (1 << 14, 0))
    assert np.allclose(x, y, atol=1e-9) and np.isfinite(x).all() and x.shape == (120, 4) and x.std() > 0


def test_layouts_by_hand(spark):
    df = spark.createDataFrame([(0, [0.0, 10.0, 5.0]), (1, [4.0, 20.0, 5.0]), (2, [8.0, 30.0, 5.0])], "id long, pos array<double>")
    assert rows(labelprop.unit_range(df)) == [(0, [-1.0, -1.0, 5.0]), (1, [0.0, 0.0, 5.0]), (2, [1.0, 1.0, 5.0])]
    p = rows(labelprop.pca_init(df, 2))
    assert [[round(v, 9) for v in r[1]] for r in p][0][0] == -1.0 and [round(r[1][0], 9) for r in p] == [-1, 0, 1]
    x, _ = blob_arrays(30, 2, 5, 9, 1.0, 1)
    got = np.array([r.pos for r in labelprop.pca_init(points(spark, x).withColumnRenamed("embedding", "pos"), 3).orderBy("id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:3].T
    assert all(abs(np.corrcoef(got[:, k], want[:, k])[0, 1]) > 0.999999 for k in range(3)) and np.abs(got).max() < 1 + 1e-9
    r = np.array([v.pos for v in labelprop.random_init(spark.range(50), 4, 7).orderBy("id").collect()])
    assert np.allclose((r * r).sum(1), 1) and np.array_equal(r, coarsening.scattered(np.arange(50), 4, 7))


# --- layout ---------------------------------------------------------------------------------------


def test_embedding(spark):
    tri = coo(spark, [(a, b, 1.0) for a in range(3) for b in range(3) if a != b], "src, dst, w")
    start = labelprop.random_init(spark.range(3), 2)
    a, b = (rows(node_embedding(tri, start.repartition(n), EmbeddingParams(n_epochs=20))) for n in (1, 3))
    assert a == b and all(math.isfinite(v) for _, p in a for v in p)
    by_epochs = rows(node_embedding(tri, start, EmbeddingParams(n_epochs=4), one_task_rows=0))
    assert np.allclose([p for _, p in by_epochs], [p for _, p in rows(node_embedding(tri, start, EmbeddingParams(n_epochs=4)))])
    assert rows(node_embedding(tri, start, EmbeddingParams(n_epochs=0))) == rows(start)
    assert rows(node_embedding(tri.limit(0), start, EmbeddingParams(n_epochs=5))) == rows(start)
    far = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0])], "id long, pos array<double>")
    end = rows(node_embedding(coo(spark, [(0, 1, 1.0), (1, 0, 1.0)], "src, dst, w"), far, EmbeddingParams(n_epochs=100, negative_sample_rate=0)))
    assert math.dist(end[0][1], end[1][1]) < 10


def test_schedules_match_a_running_count():
    rng = np.random.default_rng(0)
    w = rng.random(40) + 0.05
    block = Block(np.zeros(40, np.int64), np.arange(1, 41), w, w.max(), EmbeddingParams(n_epochs=60), 1)
    nxt, neg = block.period.copy(), block.negative.copy()
    for epoch in range(60):
        due = nxt <= epoch
        times = np.floor(epoch / block.period)
        assert np.array_equal(due, times > np.floor((epoch - 1) / block.period) if epoch else due & False)
        drawn = np.maximum(np.floor((epoch - neg) / block.negative), 0)
        owed = np.maximum(np.floor(epoch / block.negative) - 1, 0)
        paid = np.where(times >= 2, np.maximum(np.floor(np.ceil((times - 1) * block.period) / block.negative) - 1, 0), 0)
        assert np.allclose(drawn[due], np.maximum(owed - paid, 0)[due])
        nxt[due] += block.period[due]
        neg[due] += drawn[due] * block.negative[due]


# --- spanning tree, dendrogram --------------------------------------------------------------------


def slow_mst(x, k):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.array([np.sort(np.delete(d[i], i))[min(k, n - 1) - 1] if min(k, n - 1) > 0 else 0 for i in range(n)])
    edges = sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n))
    up, out = list(range(n)), []

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            up[b] = a
            out.append((i, j, round(w, 9)))
    return sorted(out)


@pytest.mark.parametrize("one_task_rows", [1 << 14, 3])
@pytest.mark.parametrize("k", [0, 1, 5])
def test_tree_equals_kruskal(spark, one_task_rows, k):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 5, (25, 2)).astype(float), rng.random((10, 2)) * 5])
    got = [(u, v, round(w, 9)) for u, v, w in rows(mst(points(spark, x), k, one_task_rows))]
    assert got == slow_mst(x, k)


def test_boxes_equal_brute_force_and_pass_over_most_pairs(monkeypatch):
    """Best edges out with ties, copies and bounds of components; far boxes aren't compared."""
    from tessera.operators import mst as module

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.random((2000, 3)), rng.integers(0, 4, (300, 3)) / 3, np.zeros((40, 3))])
    ids, core, comp = rng.permutation(9000)[: len(x)], rng.random(len(x)) / 20, rng.integers(0, 900, len(x))
    known, pairs, real = module.Boxes(ids, x, core), [], module._gap
    monkeypatch.setattr(module, "_gap", lambda a, b: pairs.append(len(a) * len(b)) or real(a, b))
    own = comp[known.order]
    best, other = module.nearest_other(known, own, known, own, None)
    assert sum(pairs) < 0.5 * len(x) ** 2
    w = np.maximum(real(known.x, known.x), np.maximum(known.core[:, None], known.core[None]))
    w[own[:, None] == own[None]] = np.inf
    assert (best == w.min(1)).all()
    assert (other == np.where(w == w.min(1)[:, None], known.ids[None], 1 << 40).min(1)).all()
    got, _ = module.nearest_other(known, own, known, own, np.full(900, np.inf))
    least = np.full(900, np.inf)
    np.minimum.at(least, own, best)
    mine = np.full(900, np.inf)
    np.minimum.at(mine, own, got)
    assert (mine == least).all()


def test_tree_by_hand(spark):
    assert rows(mst(points(spark, [[0, 0], [3, 4]]), 1)) == [(0, 1, 5.0)]
    assert sum(w for _, _, w in rows(mst(points(spark, [[i] for i in range(5)]), 1))) == 4
    lifted = rows(mst(points(spark, [[0, 0], [0.01, 0], [10, 0]]), 2))
    assert len(lifted) == 2 and all(w > 1 for _, _, w in lifted)
    assert mst(points(spark, [[1.0]]), 5).count() == 0 and mst(points(spark, [[1.0]]).limit(0), 5).count() == 0
    x, gt = blob_arrays(20, 2, 4, 50, 0.5, 42)
    edges = rows(mst(points(spark, x), 5))
    cross = [e for e in edges if gt[e[0]] != gt[e[1]]]
    assert len(cross) == 1 and cross[0][2] == max(w for _, _, w in edges)
    assert [r.core for r in core_distance(points(spark, [[0.0], [1.0], [5.0]]), 9).orderBy("id").collect()] == [5.0, 4.0, 5.0]


@pytest.mark.parametrize("k", [0, 4])
def test_tree_of_one_block_is_broadcast_once(spark, monkeypatch, k):
    """One block needs no table of neighbours and no checkpoint in a round; all ways grow the same tree, with many ties and any ids."""
    from tessera.operators import mst as module

    x = np.round(np.random.default_rng(k).normal(size=(300, 3)) * 2) / 2
    df = points(spark, x).selectExpr("id * 7 - 900 AS id", "embedding")
    want, blocks = rows(mst(df, k)), rows(mst(df, k, one_task_rows=3, block_rows=0))
    cuts, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda frame: cuts.append(1) or cut(frame))
    monkeypatch.setattr(module, "knn", None)
    assert rows(mst(df, k, one_task_rows=3)) == want == blocks and len(want) == 299 and len(cuts) == 1


@pytest.mark.parametrize("offset", [0, 1000])
def test_parts_are_compared_by_one_product(monkeypatch, offset):
    """Exact, copies and far origins too; only the centres need distances in full, and what speeds the products isn't written."""
    import pickle

    from tessera.operators import search as module
    from tessera.params import NearestNeighbourParams

    x = np.random.default_rng(1).normal(size=(1500, 16)) + offset
    x[700:720] = x[3]
    index = module.KmKnn(x, NearestNeighbourParams(), 42, 6)
    size, calls, squared = len(pickle.dumps(index)), [], module.squared
    monkeypatch.setattr(module, "squared", lambda a, b: calls.append(1) or squared(a, b))
    at, row = index.query(x[:200], 6)
    assert len(calls) == 1 and len(pickle.dumps(index)) == size
    d = ((x[None] - x[:200, None]) ** 2).sum(2)
    kth = np.sort(d, axis=1)[:, 5]
    assert all(set(np.flatnonzero(d[k] <= kth[k])) <= set(row[at == k]) for k in range(200))


def test_leaves_are_counted_without_walking_the_tree(monkeypatch):
    """The search condenses the tree at its two last sizes at most; sizes and labels are those of counting leaves."""
    from tessera.operators import tree as module

    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(c, 0.6, (60, 2)) for c in ((0, 0), (4, 0), (0, 5), (6, 6))]), 1)
    link = merge_edges(*grow_tree(np.arange(240), x, np.zeros(240)), np.arange(240))
    arrays = [link[c].to_numpy() for c in ("left", "right", "distance", "size")]
    condense, walks = module.condense_arrays, []
    monkeypatch.setattr(module, "condense_arrays", lambda *a: walks.append(a[-1]) or condense(*a))
    for target in range(1, 12):
        walks.clear()
        labels, strengths = module.search_arrays(*arrays, target)
        assert len(walks) <= 2
        count = lambda m: len(module.leaf_clusters(condense(*arrays, m)))
        lo, hi = 2, 120
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if count(mid) < target else (mid, hi)
        found = [(abs(count(m) - target), *module.label_arrays(c := condense(*arrays, m), module.leaf_clusters(c))) for m in (lo, hi)]
        want = min(found, key=lambda f: (f[0], -(f[1] >= 0).sum()))
        assert (labels == want[1]).all() and (strengths == want[2]).all()


@pytest.mark.parametrize("k", [0, 5, 30])
def test_wide_vectors_are_compared_by_products(spark, monkeypatch, k):
    """The tree with copies, ties and far origins is the one grown point by point; boxes of wide vectors need no distances in full."""
    from tessera.operators import mst as module

    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(300, 9)) + rng.integers(0, 3, (300, 1)) * 6, np.round(rng.normal(size=(200, 9))), np.zeros((200, 9))]) + 1000
    df = points(spark, rng.permutation(x)).selectExpr("id * 7 - 900 AS id", "embedding")
    want = rows(mst(df, k))
    assert rows(mst(df, k, one_task_rows=3)) == want and len(want) == 699
    known = module.Boxes(np.arange(len(x)), x, np.zeros(len(x)))
    monkeypatch.setattr(module, "_gap", None)
    own = np.arange(len(x)) % 90
    best, other = module.nearest_other(known, own, known, own, None)
    d = np.sqrt(((known.x[None] - known.x[:, None]) ** 2).sum(2))
    d[own[:, None] == own[None]] = np.inf
    assert (best == d.min(1)).all() and (other == np.where(d == best[:, None], known.ids[None], 1 << 40).min(1)).all()


@pytest.mark.parametrize("name", ["barcode_mst", "descendants_mst", "linkage_mst"])
def test_trees_of_whole_vectors(spark, tmp_path, name):
    """Vectors that differ in their last dimensions only are apart."""
    from tessera.queries import QUERIES

    x = np.zeros((40, 64))
    x[:, 63] = np.concatenate([np.arange(20), 30 + np.arange(20)]) / 10
    points(spark, x).selectExpr("id AS vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    if name == "linkage_mst":
        assert got.set_index("merge_id")["distance"][78] == 1.1 and got["distance"].min() == 0.3
    if name == "barcode_mst":  # both groups part at distance 1.1
        assert (got["lambda_death"] == round(math.exp(-1.1), 6)).sum() == 2
    if name == "descendants_mst":  # both groups are nodes
        held = {tuple(sorted(v)) for v in got.groupby("node")["leaf"].apply(list)}
        assert tuple(range(20)) in held and tuple(range(20, 40)) in held


def test_nearest_other_component_in_blocks(spark):
    x, _ = blob_arrays(15, 3, 3, 4, 1.0, 5)
    df = points(spark, x).join(core_distance(points(spark, x), 3), "id").withColumn("comp", F.col("id") % 4).cache()
    assert rows(nearest_other_component(df)) == rows(nearest_other_component(df, block_rows=10))
    assert nearest_other_component(df.withColumn("comp", F.lit(1).cast("long"))).count() == 0


def test_descendants_are_written_in_bounded_pieces(spark, monkeypatch):
    """A caterpillar of 700 leaves has n^2 / 2 rows; no task returns them at once, and forests and empty tables are fine."""
    from tessera.operators import mst as module

    monkeypatch.setattr(module, "PIECE", 100)
    monkeypatch.setattr(module, "TASK_ROWS", 20_000)
    n, x = 700, np.arange(700)[:-1]
    link = linkage(spark.createDataFrame(pd.DataFrame({"u": x, "v": x + 1, "w": x + 1.0})))
    out = module.descendants(link)
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    assert len(sizes) >= 12 and sizes.max() < 2 * sizes.mean()
    got = out.groupBy("node").agg(F.count("leaf").alias("n"), F.countDistinct("leaf").alias("d"), F.max("leaf").alias("m")).toPandas()
    assert len(got) == n - 1 and (got["n"] == got["node"] - n + 2).all() and (got["d"] == got["n"]).all() and (got["m"] == got["n"] - 1).all()
    two = spark.createDataFrame([(4, 1, 0, 1.0, 2), (5, 3, 2, 1.0, 2)], "merge_id long, left long, right long, distance double, size long")
    assert rows(module.descendants(two)) == [(4, 0), (4, 1), (5, 2), (5, 3)] and module.descendants(two.limit(0)).count() == 0


def test_linkage_and_components(spark):
    tree_ = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0), (0, 2, 10.0)], "u long, v long, w double")
    assert rows(linkage(tree_)) == [(4, 1, 0, 1.0, 2), (5, 3, 2, 1.0, 2), (6, 5, 4, 10.0, 4)]
    assert linkage(tree_.limit(0)).count() == 0
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert rows(connected_components(spark.range(9), links)) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7)]


def dendro(x, k):
    n = len(x)
    u, v, w = grow_tree(np.arange(n), x, np.array([np.sort(np.sqrt(((x - p) ** 2).sum(1)))[min(k, n - 1)] for p in x]))
    return [merge_edges(u, v, w, np.arange(n))[c].to_numpy() for c in ("left", "right", "distance", "size")]


@pytest.mark.parametrize(("n", "c", "k"), [(30, 2, 5), (30, 3, 5)])
def test_leaves_and_labels_of_blobs(n, c, k):
    x, gt = blob_arrays(n, c, 4, 50, 0.5, 42)
    d = dendro(x, k)
    assert (np.diff(d[2]) >= 0).all() and d[3][-1] == len(x)
    cond = tree.condense_arrays(*d, 5)
    assert len(tree.leaf_clusters(cond)) >= c
    found, strengths = tree.label_arrays(cond, tree.leaf_clusters(cond))
    assert ((strengths >= 0) & (strengths <= 1)).all() and (strengths[found < 0] == 0).all()
    wide, wgt = blob_arrays(40, 2, 4, 100, 0.3, 42)
    cond = tree.condense_arrays(*dendro(wide, 5), 15)
    found, _ = tree.label_arrays(cond, tree.leaf_clusters(cond))
    assert accuracy(found, wgt) > 0.9


def accuracy(labels, gt):
    hits = sum(Counter(gt[labels == l].tolist()).most_common(1)[0][1] for l in set(labels.tolist()) if l >= 0)
    return hits / len(gt)


def slow_condensed(left, right, distance, size, m):
    """Cluster and lambda of every point, from its chain of ancestors."""
    n = len(left) + 1
    up = {}
    for k in range(n - 1):
        up[int(left[k])] = up[int(right[k])] = n + k
    total = lambda v: 1 if v < n else int(size[v - n])
    split = {n + k: total(left[k]) >= m and total(right[k]) >= m for k in range(n - 1)}
    out = []
    for p in range(n):
        node = p
        while total(node) < m and node in up:
            node = up[node]
        lam = 1 / distance[node - n] if distance[node - n] > 0 else math.inf
        c = node
        while c in up and not split[up[c]]:
            c = up[c]
        out.append((c, p, lam))
    return out


def test_condensed_tree_equals_ancestor_chains():
    rng = np.random.default_rng(8)
    for n, m in ((2, 2), (3, 2), (40, 3), (60, 5), (30, 100)):
        x = rng.integers(0, 9, (n, 2)).astype(float)
        d = dendro(x, 2)
        c = tree.condense_arrays(*d, m)
        points_ = ~c.is_cluster
        got = sorted(zip(c.parent[points_].tolist(), c.child[points_].tolist(), c.lam[points_].tolist()), key=lambda r: r[1])
        assert got == slow_condensed(*d, m)
    with pytest.raises(ValueError):
        tree.condense_arrays(*dendro(np.zeros((3, 1)), 1), 1)


def test_frames_equal_arrays(spark):
    x, _ = blob_arrays(25, 3, 3, 8, 1.2, 42)
    d = dendro(x, 2)
    n = len(x)
    link = spark.createDataFrame(pd.DataFrame({"merge_id": np.arange(n, 2 * n - 1), "left": d[0], "right": d[1], "distance": d[2], "size": d[3]}))
    c = tree.condense_arrays(*d, 3)
    frame = tree.condense_tree(link, 3).cache()
    assert rows(frame) == sorted(zip(c.parent.tolist(), c.child.tolist(), c.lam.tolist(), c.size.tolist()))
    chosen = tree.extract_leaves(frame).cache()
    assert [r[0] for r in rows(chosen)] == tree.leaf_clusters(c).tolist()
    found, strengths = tree.label_arrays(c, tree.leaf_clusters(c))
    lab = tree.cluster_labels(frame, chosen)
    assert [r[1] for r in rows(lab)] == found.tolist() and found.max() >= 2
    assert np.allclose([r[1] for r in rows(tree.membership_strength(frame, chosen, lab))], strengths)
    b = tree.barcode_arrays(c, 3, n)
    bars = tree.barcode(frame, 3).cache()
    assert rows(bars.select("cluster_id", "size_birth", "size_death", "parent")) == sorted(zip(b.cluster.tolist(), b.birth.tolist(), b.death.tolist(), b.parent.tolist()))
    assert b.death[0] == n and b.parent[0] == b.cluster[0]
    sizes, total = tree.persistence_arrays(b)
    assert np.allclose([list(r) for r in rows(tree.total_persistence(bars))], np.stack([sizes, total], axis=1))
    got = rows(tree.find_peaks(tree.total_persistence(bars)))
    assert [r[0] for r in got] == tree.peak_positions(total)
    for a, z, j in rows(tree.layer_jaccard(bars, bars.select(F.col("size_birth").alias("size")).distinct())):
        assert abs(j - tree.jaccard(b, a, z)) < 1e-9
    peaks = tree.diverse(tree.peak_positions(total), sizes, total, b, 0.2, 9)
    assert [r[1] for r in rows(tree.diverse_peaks(bars, 0.2, 9))] == sizes[peaks].tolist()
    mid = float(np.median(sizes))
    assert [r[1] for r in rows(tree.cluster_labels(frame, tree.active_clusters(bars, mid)))] == tree.label_arrays(c, b.active(mid))[0].tolist()


def test_peaks_and_layers_by_hand():
    peaks = lambda v: tree.peak_positions(np.array(v, dtype=float))
    assert peaks([0, 1, 0, 2, 0]) == [1, 3] and peaks([0, 1, 1, 0]) == [1] and peaks([1, 2, 3, 4, 5]) == [] and peaks([]) == []
    b = tree.Barcode(*(np.array(v) for v in ([9, 1, 2], [2.0, 2, 4], [9.0, 4, 6], [9, 9, 9], [0.0, 1, 1])))
    assert tree.diverse([1], np.array([2.0, 3, 4]), np.array([0.0, 5, 0]), b, 0.2, 5) == [1]
    assert tree.diverse([1], np.array([2.0, 3, 4]), np.array([0.0, 5, 0]), b, 0.2, 0) == []
    x, gt = blob_arrays(50, 3, 4, 50, 0.5, 42)
    found = tree.layers_arrays(tree.condense_arrays(*dendro(x, 5), 5), 150, 5, 0.2, 10)
    counts = [labels.max() + 1 for labels, _, _ in found]
    assert counts == sorted(counts, reverse=True) and counts[0] >= 3 and found[0][2] == 0.0
    assert max(accuracy(labels, gt) for labels, _, _ in found) > 0.9
    assert len(tree.layers_arrays(tree.condense_arrays(*dendro(x, 5), 5), 150, 5, 0.2, 0)) == 1
    one, _ = blob_arrays(30, 1, 4, 0, 0.5, 42)
    assert all(labels.max() + 1 <= 1 for labels, _, _ in tree.layers_arrays(tree.condense_arrays(*dendro(one, 5), 15), 30, 15, 0.2, 10)[:1])


def test_search_for_a_number_of_clusters():
    x, gt = blob_arrays(30, 2, 4, 50, 0.5, 42)
    labels, strengths = tree.search_arrays(*dendro(x, 5), 2)
    assert labels.max() + 1 == 2 and accuracy(labels, gt) > 0.95
    x, _ = blob_arrays(25, 5, 4, 50, 0.5, 42)
    assert 3 <= tree.search_arrays(*dendro(x, 5), 5)[0].max() + 1 <= 7
    assert (tree.search_arrays(*dendro(np.zeros((3, 1)), 1), 2)[0] == -1).all()
