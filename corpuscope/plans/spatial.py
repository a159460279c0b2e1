"""Boxes within reach of each other, in any number of dimensions.

A tree of splits at sampled medians cuts space into leaves of about equally many boxes.
Each box, grown by half the reach on every side, is sent to all leaves it touches; two
boxes within reach overlap when grown, and the lower corner of that overlap lies in one
leaf only, which reports the pair.  The sample decides the balance, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import materialise

#: Boxes wanted in a leaf, leaves at most, and sampled boxes for each leaf.
LEAF_BOXES = 1000
MAX_LEAVES = 8192
SAMPLED = 16
#: Rows of a leaf compared at once.
_ROWS = 256


@dataclass
class Splits:
    """A tree in arrays: node i splits ``axis`` at ``at``; negative children are leaves."""

    axis: list[int]
    at: list[float]
    below: list[int]
    above: list[int]

    @classmethod
    def from_sample(cls, points: np.ndarray, leaves: int) -> Splits:
        """Medians along the widest axis until there are ``leaves`` leaves or no spread."""
        tree, count = cls([], [], [], []), 0

        def grow(rows: np.ndarray, wanted: int) -> int:
            nonlocal count
            spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
            axis = int(spread.argmax())
            if wanted < 2 or not spread[axis] > 0:
                count += 1
                return -count
            values = np.sort(rows[:, axis])
            at = float(values[len(values) // 2])
            if at == values[0]:
                at = float(values[np.searchsorted(values, at, side="right")])
            node = len(tree.axis)
            tree.axis.append(axis)
            tree.at.append(at)
            tree.below.append(0)
            tree.above.append(0)
            left = rows[:, axis] < at
            tree.below[node] = grow(rows[left], wanted // 2)
            tree.above[node] = grow(rows[~left], wanted - wanted // 2)
            return node

        grow(points, leaves)
        return tree

    def touched(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of every leaf that each box from ``lo`` to ``hi`` touches."""
        rows, leaves = [], []
        stack = [(0 if self.axis else -1, np.arange(len(lo)))]
        while stack:
            node, here = stack.pop()
            if not len(here):
                continue
            if node < 0:
                rows.append(here)
                leaves.append(np.full(len(here), -node))
                continue
            axis, at = self.axis[node], self.at[node]
            stack.append((self.below[node], here[lo[here, axis] < at]))
            stack.append((self.above[node], here[hi[here, axis] >= at]))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(rows), np.concatenate(leaves)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dims)


def _pairs_of_leaf(lo: np.ndarray, hi: np.ndarray, reach: float, splits: Splits, leaf: int):
    """Rows (a, b) of the boxes within reach whose grown overlap begins in this leaf."""
    half = _half(reach)
    axis = int((lo.max(axis=0) - lo.min(axis=0)).argmax())
    order = np.argsort(lo[:, axis], kind="stable")
    starts = lo[order, axis]
    for begin in range(0, len(order), _ROWS):
        block = order[begin : begin + _ROWS]
        # Boxes that begin beyond the end of the block cannot be near; earlier ones may.
        stop = np.searchsorted(starts, hi[block, axis].max() + 2 * half, side="right")
        others = order[:stop]
        others = others[hi[others, axis] >= lo[block, axis].min() - 2 * half]
        squares = np.zeros((len(block), len(others)))
        for d in range(lo.shape[1]):
            gap = np.maximum(
                lo[others, d][None, :] - hi[block, d][:, None], lo[block, d][:, None] - hi[others, d][None, :]
            )
            squares += np.square(np.maximum(gap, 0.0))
        i, j = np.nonzero(squares <= reach * reach + 1e-12)
        a, b = block[i], others[j]
        corner = np.maximum(lo[a], lo[b]) - half
        rows, leaves = splits.touched(corner, corner)
        mine = np.zeros(len(a), bool)
        mine[rows[leaves == leaf]] = True
        yield a[mine], b[mine]


def _half(reach: float) -> float:
    return reach / 2 * (1 + 1e-9) + 1e-6


def near_boxes(
    boxes: DataFrame, reach: float, leaf_boxes: int = LEAF_BOXES, max_leaves: int = MAX_LEAVES
) -> DataFrame:
    """``(a, b)``: ordered pairs of boxes at most ``reach`` apart, each with itself too.

    ``boxes`` has ``box`` (any type, unique) and the corners ``lo`` and ``hi``, arrays of
    equal length without nulls.
    """
    boxes = materialise(boxes.select("box", "lo", "hi"))
    n, dims = boxes.select(F.count(F.lit(1)), F.max(F.size("lo"))).first()
    kind = boxes.schema["box"].dataType.simpleString()
    if not n:
        return boxes.select(F.col("box").alias("a"), F.col("box").alias("b"))
    leaves = min(-(-n // leaf_boxes), max_leaves)
    sample = boxes.sample(min(1.0, 2.0 * SAMPLED * leaves / n), seed=1).select("lo").limit(SAMPLED * leaves)
    points = np.array([r["lo"] for r in sample.collect()], dtype=float).reshape(-1, dims)
    splits = Splits.from_sample(points, leaves)
    half = _half(reach)

    def send(batches):
        for batch in batches:
            lo, hi = (_matrix(batch.column(c), dims) for c in ("lo", "hi"))
            rows, leaf = splits.touched(lo - half, hi + half)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype("int32")), *taken.columns], names=["leaf", *taken.schema.names])

    def join(key, table):
        lo, hi = (_matrix(table.column(c), dims) for c in ("lo", "hi"))
        ids = table.column("box").combine_chunks()
        found = list(_pairs_of_leaf(lo, hi, reach, splits, key[0].as_py()))
        a, b = (pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1))
        return pa.Table.from_arrays([ids.take(a), ids.take(b)], names=["a", "b"])

    sent = boxes.mapInArrow(send, f"leaf int, box {kind}, lo array<double>, hi array<double>")
    return sent.groupBy("leaf").applyInArrow(join, f"a {kind}, b {kind}")
