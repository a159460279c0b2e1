"""Exact top-k inner products by the threshold algorithm.

Within a block of candidates every dimension has a list of its values in order.  A
query walks all lists from the end that its own component prefers, scores each vector
that it meets in full, and stops when its k-th best score is above what any vector
not met could still reach: the sum, over the dimensions, of the query's component and
the list's current value.  Blocks of queries meet blocks of candidates, and the k best
of each query's blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16_384
#: Components at or beyond this would not leave room for exact sums of 64 bits.
LIMIT = 1 << 24


def usable(vector: Column, scale: float) -> Column:
    """True for vectors whose components are all present, finite and within the limit."""
    return F.coalesce(
        F.forall(
            vector,
            lambda x: x.isNotNull()
            & ~F.isnan(x.cast("double"))
            & (F.abs(x.cast("double")) * scale < float(LIMIT)),
        ),
        F.lit(False),
    )


class SortedLists:
    """Candidates with their positions in the order of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def top(self, query: np.ndarray, k: int, skip: int | None = None):
        """Positions and scores of the k best, best first, ties to the smaller id.

        ``skip`` is an id that is no candidate.
        """
        n = len(self.ids)
        query = query.astype(np.float64)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, dtype=bool)
        scores = np.zeros(n)
        met = np.zeros(0, np.int64)
        depth = 0
        while True:
            before, depth = depth, min(n, max(16, depth * 2))
            if len(met) * 2 > n or not (len(up) or len(down)):
                depth = n
            if depth == n:
                new = np.flatnonzero(~seen)
            else:
                found = np.concatenate(
                    [
                        self.lists[up, n - depth : n - before].ravel(),
                        self.lists[down, before:depth].ravel(),
                    ]
                )
                fresh = np.zeros(n, dtype=bool)
                fresh[found] = True
                new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            scores[new] = self.vectors[new] @ query
            if skip is not None:
                new = new[self.ids[new] != skip]
            met = np.concatenate([met, new])
            if depth == n:
                break
            if len(met) >= k:
                reach = query[up] @ self.values[up, n - depth] + query[down] @ self.values[down, depth - 1]
                kth = np.partition(scores[met], len(met) - k)[len(met) - k]
                if kth > reach:
                    break
        order = np.lexsort((met, -scores[met]))[:k]
        return met[order], scores[met[order]].astype(np.int64)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
) -> DataFrame:
    """The ``k`` candidates with the largest inner products for each query.

    Components are ``floor(scale * x)``; scores are exact integers.  Queries are the
    rows where ``is_query`` holds, candidates all rows but the query's own.  Returns
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; equal scores go to the
    smaller id; a query has fewer rows if there are fewer candidates.

    Vectors that are null or hold a null, a non-finite component or one of 2**24 or
    more after scaling take no part; nor do rows with a null id.  Shorter vectors count
    as followed by zeros.  Rows that share an id count once.  An empty table gives no
    rows; other columns are ignored.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = (
        vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), scale))
        .select(
            F.col(id_col).cast("bigint").alias("vec_id"),
            whole.alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("query"),
        )
        .dropDuplicates(["vec_id"])
    )
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("query").cast("bigint")), F.lit(0)).alias("q")
    ).first()
    q_blocks = max(1, -(-size["q"] // QUERY_BLOCK))
    c_blocks = max(1, -(-size["n"] // CANDIDATE_BLOCK))
    side = lambda seed, blocks: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = rows.select(
        "vec_id", "vector", F.lit(False).alias("query"), side(1, c_blocks).alias("c"), every(q_blocks).alias("q")
    )
    queries = rows.where("query").select(
        "vec_id", "vector", F.lit(True).alias("query"), every(c_blocks).alias("c"), side(2, q_blocks).alias("q")
    )

    def meet(key, table):
        ids = table.column("vec_id").to_numpy()
        flags = table.column("query").to_numpy()
        lists = table.column("vector").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        matrix = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
        inside = np.arange(matrix.shape[1])[None, :] < lengths[:, None]
        matrix[inside] = lists.flatten().to_numpy(zero_copy_only=False)
        block = SortedLists(ids[~flags], matrix[~flags])
        out = [[], [], []]
        for query_id, query in zip(ids[flags].tolist(), matrix[flags], strict=True):
            place, score = block.top(query, k, skip=query_id)
            out[0].append(np.full(len(place), query_id))
            out[1].append(block.ids[place])
            out[2].append(score)
        names = ["query_id", "vec_id", "score"]
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(names, columns, strict=True)))

    found = (
        candidates.unionByName(queries)
        .groupBy("c", "q")
        .applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
