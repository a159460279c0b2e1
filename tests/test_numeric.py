"""Invariants of factorizations, clusters and communities, checked with numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import cluster as K
from corpuscope.operators import factor as D
from corpuscope.operators import graph as G
from corpuscope.operators import matrix as M
from corpuscope.plans.lineage import materialise
from corpuscope.plans.spatial import Splits, near_boxes


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    m = rng.poisson(2, (9, 5)).astype(float) + 0.5
    cells = [(f"r{i}", f"c{j}", float(m[i, j])) for i in range(9) for j in range(5)]
    return m, spark.createDataFrame(cells, "row string, col string, v double")


def dense(df, row, axis, value, n, k):
    out = np.zeros((n, k))
    for r in df.collect():
        out[int(str(r[row])[1:]), r[axis]] = r[value]
    return out


def test_svd_rebuilds_the_matrix(table):
    m, cells = table
    parts = D.svd(cells, "row", "col", "v", 5)
    u = dense(parts["rows"], "row", "axis", "value", 9, 5)
    v = dense(parts["cols"], "col", "axis", "value", 5, 5)
    s = np.array([r["singular_value"] for r in parts["axes"].orderBy("axis").collect()])
    assert np.allclose(u @ np.diag(s) @ v.T, m)
    assert np.allclose(u.T @ u, np.eye(5), atol=1e-6)


def test_correspondence_analysis(table):
    m, cells = table
    p = m / m.sum()
    r, c = p.sum(1), p.sum(0)
    z = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    _, s, _ = np.linalg.svd(z)
    parts = D.correspondence_analysis(cells, "row", "col", "v", 4)
    got = [x["eigenvalue"] for x in parts["axes"].orderBy("axis").collect()]
    assert np.allclose(got, s[:4] ** 2, atol=1e-9)
    rows = dense(parts["rows"], "row", "axis", "principal", 9, 4)
    cols = dense(parts["cols"], "col", "axis", "standard", 5, 4)
    assert np.allclose((np.sqrt(r)[:, None] * rows) @ (np.sqrt(c)[:, None] * cols).T, z, atol=1e-8)
    scores = parts["rows"].groupBy("row").agg(F.sum("score").alias("s")).collect()
    assert np.allclose([x["s"] for x in scores], 1)


def test_pca_scores(table):
    m, cells = table
    parts = D.pca(cells, "row", "col", "v", 5)
    scores = dense(parts["rows"], "row", "axis", "value", 9, 5)
    values = [x["eigenvalue"] for x in parts["axes"].orderBy("axis").collect()]
    assert np.allclose(scores.mean(0), 0) and np.allclose(scores.var(0, ddof=1), values)


def test_mds_keeps_distances(spark):
    x = np.random.default_rng(4).normal(size=(7, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    cells = [(f"t{i}", f"t{j}", float(d[i, j])) for i in range(7) for j in range(7)]
    y = dense(D.mds(spark.createDataFrame(cells, "t1 string, t2 string, value double")), "term", "axis", "value", 7, 2)
    assert np.allclose(np.linalg.norm(y[:, None] - y[None], axis=2), d)


@pytest.mark.parametrize("dims, eps", [(1, 0.4), (2, 0.4), (3, 0.4), (5, 0.9), (10, 1.6)])
def test_density_clusters_match_definition(spark, dims, eps):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.35, (25, dims)) for c in (0, 2, 5)] + [rng.uniform(-3, 9, (15, dims)), np.zeros((6, dims))])
    least = 4
    cells = [(i, a, float(x[i, a])) for i in range(len(x)) for a in range(dims)]
    got = {r["term"]: r["cluster"] for r in K.density_clusters(spark.createDataFrame(cells, "term int, axis int, value double"), eps, least).collect()}
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(1) >= least
    label = list(range(len(x)))
    for _ in x:
        for i in np.flatnonzero(core):
            label[i] = min(label[j] for j in np.flatnonzero(near[i] & core))
    for i in range(len(x)):
        if core[i]:
            same = {j for j in np.flatnonzero(core) if label[j] == label[i]}
            assert same == {j for j in np.flatnonzero(core) if got[j] == got[i]}
        else:
            assert (got[i] is None) == (not (near[i] & core).any())


def test_dense_cells_are_cut_before_their_points_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(3)
    eps, side = 1.0, 1.0 / 2**0.5
    # Three cells, the second and third about eps from the first.
    x = {0: rng.uniform(0, 0.7, (40, 2)), 2: rng.uniform(0, 0.7, (40, 2)) + [2 * side, 0], 3: rng.uniform(0.1, 0.5, (40, 2)) + [3 * side, 0]}
    rows = [(p.tolist(), [c, 0]) for c, some in x.items() for p in some]
    points = spark.createDataFrame(rows, "x array<double>, cell array<int>").coalesce(1)
    boxes = K._boxes(points, 2, "cell")
    pairs = spark.createDataFrame([([0, 0], [2, 0]), ([0, 0], [3, 0])], "a array<int>, b array<int>")
    pairs = K._facing(pairs, boxes, "cell", eps).where("NOT sure")
    seen, count = [], K._open_comparisons
    monkeypatch.setattr(K, "COMPARED", 200)
    monkeypatch.setattr(K, "_open_comparisons", lambda some: seen.append(count(some)) or seen[-1])
    got = {(r["a_cell"][0], r["b_cell"][0]) for r in K._cells_that_meet(points, pairs, 2, eps, side).collect()}
    assert seen[0] > 200 >= seen[-1]
    assert got == {(0, c) for c in (2, 3) if np.linalg.norm(x[0][:, None] - x[c][None], axis=2).min() <= eps}


@pytest.mark.parametrize("dims", [1, 2, 6])
def test_near_boxes_match_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    # Half of the boxes crowd around one border of the tree.
    lo = np.vstack([rng.uniform(0, 10, (300, dims)), np.full((300, dims), 5.0) + rng.normal(0, 0.05, (300, dims))])
    hi = lo + rng.uniform(0, 0.3, lo.shape)
    reach = 0.2 * dims
    rows = [([i, -i], lo[i].tolist(), hi[i].tolist()) for i in range(len(lo))]
    boxes = spark.createDataFrame(rows, "box array<int>, lo array<double>, hi array<double>").repartition(3)
    found = near_boxes(boxes, reach, leaf_boxes=25).collect()
    got = {(r["a"][0], r["b"][0]) for r in found}
    gaps = np.maximum(np.maximum(lo[None] - hi[:, None], lo[:, None] - hi[None]), 0)
    assert len(found) == len(got)
    assert got == set(zip(*map(list, np.nonzero(np.square(gaps).sum(2) <= reach**2 + 1e-12))))
    assert near_boxes(boxes.limit(0), reach).collect() == []


def test_splits_balance_a_crowd(spark):
    """Most boxes at one border: medians cut the crowd itself into leaves."""
    rng = np.random.default_rng(3)
    points = np.vstack([rng.uniform(-100, 100, (1000, 2)), rng.normal(0, 0.01, (20_000, 2))])
    splits = Splits.from_sample(points[rng.choice(len(points), 1600, replace=False)], 100)
    rows, leaves = splits.touched(points, points)
    assert len(rows) == len(points)
    assert np.bincount(leaves).max() < 6 * len(points) / 100


def two_cliques(spark):
    edges = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 1.0)]
    return spark.createDataFrame(edges, "t1 string, t2 string, value double")


def test_louvain_finds_two_cliques(spark):
    groups = {}
    for r in G.louvain(two_cliques(spark)).collect():
        groups.setdefault(r["cluster"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[f"{s}{i}" for i in range(5)] for s in "ab"]


def test_label_propagation_settles_on_a_commonest_label(spark):
    edges = two_cliques(spark)
    label = {r["node"]: r["cluster"] for r in G.label_propagation(edges).collect()}
    around = {}
    for r in edges.collect():
        around.setdefault(r["t1"], []).append(label[r["t2"]])
        around.setdefault(r["t2"], []).append(label[r["t1"]])
    for node, labels in around.items():
        assert labels.count(label[node]) == max(map(labels.count, labels))


def test_modularity(spark):
    edges = two_cliques(spark)
    adj = materialise(G._adjacency(edges, True))
    halves = adj.select("node", F.substring("node", 1, 1).alias("cluster")).distinct()
    assert abs(G.modularity(adj, halves) - (20 / 21 - 0.5)) < 1e-9


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.format_string("n%03d", "id").alias("t1"), F.format_string("n%03d", F.col("id") + 1).alias("t2"))
    got = G.connected_components(edges).select("cluster").distinct().collect()
    assert [r[0] for r in got] == ["n000"]


def test_kendall_matches_its_definition():
    rng = np.random.default_rng(8)
    for m in (2, 3, 7, 16, 33):
        x, y = rng.integers(0, 5, (40, m)).astype(float), rng.normal(size=(40, m)).round(1)
        x[0] = 1.0
        got = M.kendall(x, y)
        for a, b, t in zip(x, y, got):
            i, j = np.triu_indices(m, 1)
            sx, sy = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
            norm = np.sqrt((sx**2).sum() * (sy**2).sum())
            assert np.isnan(t) if norm == 0 else t == pytest.approx((sx * sy).sum() / norm)
    assert np.isnan(M.kendall(np.ones((2, 1)), np.ones((2, 1)))).all()


def test_kendall_of_long_profiles_is_fast():
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 50, (20, 3000)).astype(float), rng.integers(0, 50, (20, 3000)).astype(float)
    M.kendall(x[:1], y[:1])
    start = time.time()
    M.kendall(x, y)
    assert (time.time() - start) / 20 < 0.05
