"""Graphs as blocks of whole components, so that loops over a component stay in one task.

Components are found by contraction, in a number of rounds logarithmic in the longest way.
Those of bounded size are dealt to tasks whole; only larger ones need rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import is_empty, materialise

#: Links of a component that is handled in one task at most.
BLOCK_LINKS = 1_000_000
#: Links that a task handles at once, if no component has more.
CHUNK_LINKS = 500_000


def component_names(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of the links ``(a, b)`` that are no loops.

    Every round hooks each node to its neighbour of least hash if that is below its own, renames
    the ends of the links and drops loops, until none is left; the hooks are then followed back.
    Hashes differ from round to round, so a part of the nodes leaves each time whatever their order.
    """
    edges = materialise(edges.where("a <> b"))
    hooks = []
    while not hooks or not is_empty(edges):
        rank = [F.xxhash64(c, F.lit(len(hooks))) for c in ("up", "node")]
        ends = edges.toDF("node", "up").union(edges.select("b", "a"))
        least = ends.groupBy("node").agg(F.min_by("up", rank[0]).alias("up"))
        hook = materialise(least.select("node", F.when(rank[0] < rank[1], F.col("up")).otherwise(F.col("node")).alias("up")))
        hooks.append(hook)
        named = edges.join(hook.toDF("a", "_a"), "a").join(hook.toDF("b", "_b"), "b").where("_a <> _b")
        edges = materialise(named.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct())
    found = hooks.pop().toDF("node", "component")
    for hook in reversed(hooks):
        # A node's hook in one round is the node that goes on in the next, if it still has links.
        found = materialise(
            hook.join(found.toDF("up", "_root"), "up", "left").select("node", F.coalesce("_root", "up").alias("component"))
        )
    return found


def by_component(links: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame | None]:
    """The links of small components with their ``component``, and those of large ones if any.

    ``links`` should be a written table without loops and nulls.
    """
    names = component_names(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
    placed = materialise(links.join(names.withColumnRenamed("node", a), a))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    # Fewer than one in BLOCK_LINKS links.
    large = sizes.where(F.col("_n") > BLOCK_LINKS).select("component").collect()
    if not large:
        return placed, None
    kind = placed.select("component").schema
    known = F.broadcast(placed.sparkSession.createDataFrame(large, kind))
    rest = placed.join(known, "component", "left_semi").drop("component")
    return placed.join(known, "component", "left_anti"), rest


def dealt(placed: DataFrame) -> DataFrame:
    """Rows by their ``component``, each in one task and together."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "component").sortWithinPartitions("component")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole components from rows that :func:`dealt` has put in order."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_LINKS:
            table = pa.Table.from_batches(held).combine_chunks()
            # The last component may go on in the next batch.
            names = table.column("component")
            cut = pc.index(names, names[-1]).as_py()
            if cut:
                yield table.slice(0, cut)
                held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of the columns in ascending order, and each column as places there."""
    joined = pa.concat_arrays([chunk for c in columns for chunk in c.chunks])
    codes = joined.dictionary_encode()
    order = pc.array_sort_indices(codes.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    places = rank[codes.indices.to_numpy(zero_copy_only=False)]
    cuts = np.cumsum([len(c) for c in columns])[:-1]
    return codes.dictionary.take(order), np.split(places, cuts)
