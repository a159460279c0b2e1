"""Connected components by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import is_empty, stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; the smallest node names it.

    Every round hooks each node to its smallest neighbour if that is smaller, renames
    the ends of the edges and drops loops, until no edge is left.  Each node of an
    edge that is no local minimum leaves, so the edges shrink fast; nothing is
    collected.  The hooks are then followed backwards.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    hooks = []
    while not is_empty(edges):
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("b").alias("up"))
        )
        hook = stored(ends.groupBy("node").agg(F.min("up").alias("up")))
        hooks.append(hook)
        first = hook.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        second = hook.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        edges = stored(
            edges.join(first, "a")
            .join(second, "b")
            .select(F.greatest("a_up", "b_up").alias("a"), F.least("a_up", "b_up").alias("b"))
            .where("a <> b")
            .distinct()
        )
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # A node's hook in one round is the node that goes on in the next.
    found = None
    for hook in reversed(hooks):
        step = hook.select(F.col("node"), F.col("up"))
        if found is None:
            ups = hook.select(F.col("node").alias("up"), F.col("up").alias("root"))
            labels = step
        else:
            ups = found.select(F.col("node").alias("up"), F.col("component").alias("root"))
            labels = step
        joined = labels.join(ups, "up", "left").select(
            "node", F.coalesce("root", "up").alias("component")
        )
        found = stored(joined)
    return found
