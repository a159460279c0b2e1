"""Spanning forests and their levels against Kruskal's algorithm; long chains of citations."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import graph, linkage
from corpuscope.operators.cluster import threshold_clusters


def kruskal(rows):
    best = {}
    for a, b, v in rows:
        if a is not None and b is not None and a != b and v is not None and v == v:
            key = (min(a, b), max(a, b))
            best[key] = max(v, best.get(key, v))
    parent, kept = {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (a, b), v in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            kept.append((a, b, v))
    return sorted(kept)


def shapes():
    rng = random.Random(7)
    ties = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}", float(rng.randrange(4))) for _ in range(150)]
    parts = [(f"{p}{rng.randrange(9)}", f"{p}{rng.randrange(9)}", rng.random()) for p in "abc" for _ in range(25)]
    chain = [(f"c{i:03}", f"c{i + 1:03}", float(i)) for i in range(90)]
    star = [("hub", f"s{i:03}", 1.0) for i in range(60)]
    odd = [("a", "b", None), ("b", "c", float("nan")), (None, "c", 1.0), ("c", "c", 2.0), ("d", "e", -1.0), ("e", "d", 3.0)]
    return {"ties": ties, "parts": parts, "chain": chain, "star": star, "odd": odd, "none": []}


@pytest.mark.parametrize("name", list(shapes()))
def test_forest_is_kruskals(spark, name):
    rows = shapes()[name]
    got = linkage.spanning_forest(spark.createDataFrame(rows, "t1 string, t2 string, value double")).collect()
    assert sorted(map(tuple, got)) == kruskal(rows)


def test_levels_equal_threshold_clusters(spark):
    rows = [r for r in shapes()["parts"] if r[0] != r[1]]
    edges = spark.createDataFrame(rows, "t1 string, t2 string, value double")
    edges = edges.union(edges.select("t2", "t1", "value"))
    nodes = edges.select(F.col("t1").alias("node")).distinct()
    forest = linkage.spanning_forest(edges)
    levels = [0.0, 0.4, 0.8, 2.0]
    got = linkage.linkage_levels(forest, nodes, levels).collect()
    for level in levels:
        want = {tuple(r) for r in threshold_clusters(edges, level).collect()}
        assert {(r["node"], r["cluster"]) for r in got if r["threshold"] == level} == want
    profile = {r["value"]: r["clusters"] for r in linkage.linkage_profile(forest, nodes).collect()}
    for value in sorted(profile)[::6]:
        assert profile[value] == threshold_clusters(edges, value).select("cluster").distinct().count()


def counted(links):
    """Paths through each link, by recursion."""
    after, before = {}, {}
    for s, d in links:
        after.setdefault(s, []).append(d)
        before.setdefault(d, []).append(s)

    def paths(x, step, known):
        if x not in known:
            known[x] = sum(paths(y, step, known) for y in step.get(x, [])) or 1
        return known[x]

    up, down = {}, {}
    return sorted((s, d, paths(s, before, up) * paths(d, after, down)) for s, d in set(links))


def test_chains_between_branches_are_one_link(spark):
    rng = random.Random(3)
    links, n = [], 1000
    for _ in range(14):  # chains of several lengths between eight branching nodes, some parallel
        a, b = sorted(rng.sample(range(8), 2))
        inner = list(range(n, n + rng.randrange(6)))
        n += 10
        ends = [a, *inner, b]
        links += list(zip(ends, ends[1:]))
    links += [(50, 51), (51, 52)]  # a chain apart
    got = graph.path_counts(spark.createDataFrame(links, "src int, dst int"))
    assert sorted((r[0], r[1], int(r[2])) for r in got.collect()) == counted(links)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    put = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: written.append(1) or put(df))
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.path_counts(chain).agg(F.count("*"), F.min("count"), F.max("count")).first()
    assert (got[0], int(got[1]), int(got[2])) == (3000, 1, 1)
    assert len(written) < 40


@pytest.mark.parametrize("more", [[], [(0, 10), (0, 11)]])
def test_cycles_are_told(spark, more):
    with pytest.raises(ValueError, match="cycle"):
        graph.path_counts(spark.createDataFrame([(1, 2), (2, 3), (3, 1), *more], "src int, dst int")).collect()
