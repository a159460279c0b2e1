"""Loops over graphs: what lies in buckets is not shuffled again, and settled nodes are not asked again."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import graph
from corpuscope.plans import blocks, lineage
from corpuscope.plans.lineage import bucketed, materialise


def test_a_bucketed_table_is_not_shuffled(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = spark.range(1000).select(F.lit("f").alias("dir"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        level = materialise(spark.range(10).select(F.lit("f").alias("dir"), F.col("id").alias("a")))
        table = bucketed(links, "dir", "a")
        joined = table.join(level, ["dir", "a"])
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(r["b"] for r in joined.collect()) == list(range(1, 11))
        assert table.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_settled_nodes_do_not_vote_again(spark, monkeypatch):
    asked = []
    join = graph.skew_join

    def counted(left, right, on, how="inner", **more):
        out = join(left, right, on, how, **more)
        if on == "other" and "label" in right.columns:
            asked.append(out.select("node").distinct().count())
        return out

    monkeypatch.setattr(graph, "skew_join", counted)
    rng = random.Random(3)
    # Many pairs that settle at once and one path that takes longer.
    edges = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(400)] + [(i, i + 1) for i in range(60)]
    rng.shuffle(edges)
    labels = graph.label_propagation(spark.createDataFrame(edges, "t1 int, t2 int"))
    found = {r["node"]: r["cluster"] for r in labels.collect()}
    assert len(found) == 861 and all(found[10_000 + 2 * i] == found[10_001 + 2 * i] for i in range(400))
    assert sum(asked[:2]) == 861 and asked[-1] < 100


def _written(monkeypatch) -> list:
    """The tables that graph operators write from now on."""
    tables, write = [], lineage.materialise

    def kept(df):
        tables.append(write(df))
        return tables[-1]

    for module in (graph, blocks):
        monkeypatch.setattr(module, "materialise", kept)
    return tables


def _ladders(spark, n, length):
    """Small components with many levels: node k of a ladder follows k - 1 and k - 3, as some others do."""
    rng = random.Random(5)
    rows = [
        (1000 * c + k - back, 1000 * c + k)
        for c in range(n)
        for k in range(length - c % 7)
        for back in (1, 3, rng.randrange(2, 9))
        if k >= back
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "src long, dst long").distinct()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _ways(links):
    """Number of ways through each link, whose ends ascend."""
    f, b = {}, {}
    for s, d in sorted(links, key=lambda e: e[1]):
        f[d] = f.get(d, 0) + f.get(s, 1)
    for s, d in sorted(links, reverse=True):
        b[s] = b.get(s, 0) + b.get(d, 1)
    return sorted((s, d, n if (n := f.get(s, 1) * b.get(d, 1)) < 10**38 else None) for s, d in links)


def test_levels_of_small_components_write_no_tables(spark, monkeypatch):
    edges = materialise(_ladders(spark, 12, 220))
    tables = _written(monkeypatch)
    counts = _rows(graph.path_counts(edges))
    assert counts == _ways(_rows(edges)) and any(c is None for *_, c in counts)
    # Rounds of joins write at least one a level and direction; here it is the logarithm.
    assert len(tables) < 40


def test_paths_in_blocks_are_those_of_rounds(spark, monkeypatch):
    edges = materialise(_ladders(spark, 9, 11))
    tables = _written(monkeypatch)
    path = _rows(graph.main_path(edges))
    assert len(path) > 5 and len(tables) < 30
    monkeypatch.setattr(blocks, "BLOCK_LINKS", 20)
    assert path == _rows(graph.main_path(edges))


def test_cycles_in_blocks_raise(spark):
    for query, more in ((graph.path_counts, (2, 0)), (graph.main_path, (1, 1)), (graph.main_path, (None, 1))):
        with pytest.raises(ValueError, match="cycle"):
            query(spark.createDataFrame([(0, 1), (1, 2), (5, 6), more], "src int, dst int")).collect()


@pytest.mark.parametrize("kind", ["string"])
def test_labels_of_small_components_spread_in_one_task(spark, monkeypatch, kind):
    rng = random.Random(6)
    # Paths, even cycles (whose nodes may swap for long) and denser groups, besides loops and nulls.
    rows = [(100 * c + i, 100 * c + i + 1) for c in range(20) for i in range(c)]
    rows += [(100 * c + i, 100 * c + (i + 1) % (c % 9 + 3)) for c in range(40, 80) for i in range(c % 9 + 3)]
    rows += [(100 * c + rng.randrange(30), 100 * c + rng.randrange(30)) for c in range(80, 100) for _ in range(60)]
    rows += [(7, 7), (None, 7), (99_999, 99_999)]
    edges = spark.createDataFrame(rows, "t1 long, t2 long").select(*[F.col(c).cast(kind) for c in ("t1", "t2")])
    joined = _rows(graph.label_propagation(edges))
    monkeypatch.setattr(graph, "BLOCKS_FROM", 0)
    tables = _written(monkeypatch)
    assert _rows(graph.label_propagation(edges)) == joined
    assert len(tables) < 20
    monkeypatch.setattr(blocks, "CHUNK_LINKS", 100)
    monkeypatch.setattr(blocks, "BLOCK_LINKS", 45)
    monkeypatch.setattr(graph, "FIRST_PASSES", 1)
    assert _rows(graph.label_propagation(edges)) == joined


def test_blocks_stop_where_the_rounds_do(spark, monkeypatch):
    """The pass that ends the rounds may lie before the end of some block."""
    edges = materialise(spark.createDataFrame([(i, i + 1) for i in range(300)], "a int, b int"))
    placed, _ = blocks.by_component(edges, "a", "b")
    whole = graph._Blocks(placed)
    last = max(whole._told)
    inside = [whole.after(p)[1] for p in range(last + 1)]
    assert inside == sorted(inside) and not whole.after(last)[0]
    early = graph._Blocks(placed)
    found = early.labels(0).withColumnRenamed("node", "a")
    ends = edges.join(found, "a").join(early.labels(0).toDF("b", "other"), "b")
    assert ends.where("cluster = other").count() == inside[0]
