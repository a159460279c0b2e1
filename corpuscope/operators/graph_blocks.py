"""Label propagation and paths within blocks of whole components (see ``plans/blocks.py``)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa

from ..plans.blocks import coded, whole

_U = np.uint64
_P1, _P2, _P3, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a whole number of 32 bits after columns whose hash is ``seed``."""
    h = (seed + _P5 + _U(4)) ^ (np.array([value], _U) * _P1)
    h = ((h << _U(23)) | (h >> _U(41))) * _P2 + _P3
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))


def _links_of(start: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places of the links of some nodes, which lie together from ``start[node]`` on."""
    sizes = start[nodes + 1] - start[nodes]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[nodes] - (ends - sizes), sizes)


def propagated(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    """``(node, cluster, pass, moved, inside)``: labels after ``passes`` and what each pass did.

    Takes the links ``(component, a, b, ha, hb)`` of an undirected graph, once each, with the
    hashes of both ends.  Rows with a pass have no node; ``inside`` is by how many the links
    within a label grew.  A block at rest is left.
    """
    for table in whole(batches):
        nodes, (a, b) = coded(table.column("a"), table.column("b"))
        n = len(nodes)
        seed = np.empty(n, _U)
        for at, name in ((a, "ha"), (b, "hb")):
            seed[at] = table.column(name).to_numpy().view(_U)
        node, other = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(node, kind="stable")
        node, other = node[order], other[order]
        start = np.searchsorted(node, np.arange(n + 1))
        label, before = np.arange(n), 0
        told, changes = [], []
        for p in range(passes):
            odd = (_hash_int(p, seed) & _U(1)).astype(bool)
            moved = False
            for half in (0, 1):
                asked = odd == bool(half)
                if p:
                    # Asked in the pass before, at most three rounds ago.
                    near = np.zeros(n, bool)
                    near[other[_links_of(start, np.unique(np.concatenate(changes[-3:])))]] = True
                    asked &= near
                voters = np.flatnonzero(asked)
                at = _links_of(start, voters)
                votes, count = np.unique(node[at] * n + label[other[at]], return_counts=True)
                voter, choice = votes // n, votes % n
                # Most votes, then the present label, then the smallest.
                score = (count * 2 + (choice == label[voter])) * n + (n - 1 - choice)
                new = np.empty(0, np.int64)
                if len(voters):
                    new = n - 1 - np.maximum.reduceat(score, np.searchsorted(voter, voters)) % n
                gone = new != label[voters]
                changes.append(voters[gone])
                label[voters] = new
                moved |= bool(gone.any())
            inside = int((label[a] == label[b]).sum())
            told.append((p, moved, inside - before))
            before = inside
            if not moved:
                break
        yield _rows(nodes, nodes.take(pa.array(label)), told)


def _rows(nodes: pa.Array, clusters: pa.Array, told: list) -> pa.RecordBatch:
    kinds = [nodes.type, nodes.type, pa.int32(), pa.bool_(), pa.int64()]
    blank = [pa.nulls(len(nodes), k) for k in kinds[2:]]
    passes = [pa.nulls(len(told), k) for k in kinds[:2]]
    passes += [pa.array(x, k) for x, k in zip(zip(*told, strict=True), kinds[2:], strict=True)]
    columns = [pa.concat_arrays(x) for x in zip([nodes, clusters, *blank], passes, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["node", "cluster", "pass", "moved", "inside"])


def _levels(src: np.ndarray, dst: np.ndarray, n: int) -> list[np.ndarray] | None:
    """Links by the level of their end, each after those that lead to its start; None with a cycle."""
    order = np.argsort(src, kind="stable")
    start = np.searchsorted(src[order], np.arange(n + 1))
    need = np.bincount(dst, minlength=n)
    level, ready, depth, seen = np.zeros(n, np.int64), np.flatnonzero(need == 0), 0, 0
    while len(ready):
        seen, depth = seen + len(ready), depth + 1
        reached, times = np.unique(dst[order[_links_of(start, ready)]], return_counts=True)
        need[reached] -= times
        ready = reached[need[reached] == 0]
        level[ready] = depth
    if seen < n:
        return None
    order = np.argsort(level[dst], kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[dst[order]])) + 1)


def _counts(src: np.ndarray, dst: np.ndarray, n: int, levels: list[np.ndarray], kind) -> np.ndarray:
    """Number of ways from the sources to each node."""
    value = np.zeros(n, kind)
    value[np.bincount(dst, minlength=n) == 0] = 1
    for links in levels:
        np.add.at(value, dst[links], value[src[links]])
    return value


def _longest(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, levels: list[np.ndarray]) -> np.ndarray:
    """Largest sum of ``w`` on a way from a source to each node."""
    value = np.zeros(n, w.dtype)
    for links in levels:
        np.maximum.at(value, dst[links], value[src[links]] + w[links])
    return value


_WHOLE = pa.decimal128(38, 0)


def _decimals(values: np.ndarray) -> pa.Array:
    """Whole numbers as decimals, null beyond 38 digits."""
    if values.dtype != object:
        return pa.array(values).cast(_WHOLE)
    return pa.array([Decimal(x) if abs(x) < 10**38 else None for x in values.tolist()], _WHOLE)


def weighed(batches: Iterator[pa.RecordBatch], exact: bool, longest: bool) -> Iterator[pa.RecordBatch]:
    """``(component, src, dst, count, approx[, f_src, f_dst, b_src, b_dst])`` of the links of DAGs.

    ``count`` is the number of ways from a source to a sink through a link, null beyond 38
    digits, ``approx`` the same as a double.  With ``longest`` the largest sum of counts (or
    of ``approx`` unless ``exact``) from a source to either end and from there to a sink are
    given.  On a cycle ``approx`` is null.
    """
    names = ["f_src", "f_dst", "b_src", "b_dst"] if longest else []
    for table in whole(batches):
        nodes, (src, dst) = coded(table.column("src"), table.column("dst"))
        n = len(nodes)
        on = _levels(src, dst, n)
        kept = [table.column(c).combine_chunks() for c in ("component", "src", "dst")]
        kind = _WHOLE if exact else pa.float64()
        if on is None:
            blank = [pa.nulls(len(src), k) for k in (_WHOLE, pa.float64(), *[kind] * len(names))]
            yield pa.RecordBatch.from_arrays([*kept, *blank], ["component", "src", "dst", "count", "approx", *names])
            continue
        back = _levels(dst, src, n)
        with np.errstate(over="ignore"):
            approx = _counts(src, dst, n, on, np.float64)[src] * _counts(dst, src, n, back, np.float64)[dst]
        # Sums along a way have at most so many parts.
        most = float(approx.max()) * (len(on) + 1)
        whole_kind = np.int64 if most < 2.0**62 else object
        count = _counts(src, dst, n, on, whole_kind)[src] * _counts(dst, src, n, back, whole_kind)[dst]
        columns = [_decimals(count), pa.array(approx)]
        if longest:
            w = count if exact else approx
            f, b = _longest(src, dst, w, n, on), _longest(dst, src, w, n, back)
            columns += [_decimals(x) if exact else pa.array(x) for x in (f[src], f[dst], b[src], b[dst])]
        yield pa.RecordBatch.from_arrays([*kept, *columns], ["component", "src", "dst", "count", "approx", *names])


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(src, dst, count)``: chosen links, and those that tight links lead to from them.

    Takes ``(component, src, dst, count, chosen, back, on)``: whether a link is on a best way
    from the sources to its end, and from its start to the sinks.
    """
    for table in whole(batches):
        nodes, (src, dst) = coded(table.column("src"), table.column("dst"))
        chosen, back, on = (table.column(c).to_numpy() for c in ("chosen", "back", "on"))
        keep = chosen.copy()
        for at, to, tight in ((dst, src, back), (src, dst, on)):
            links = np.flatnonzero(tight)
            links = links[np.argsort(at[links], kind="stable")]
            start = np.searchsorted(at[links], np.arange(len(nodes) + 1))
            seen = np.zeros(len(nodes), bool)
            front = np.unique(to[chosen])
            while len(front):
                seen[front] = True
                steps = links[_links_of(start, front)]
                keep[steps] = True
                front = np.unique(to[steps])
                front = front[~seen[front]]
        rows = pa.array(np.flatnonzero(keep))
        picked = table.select(["src", "dst", "count"]).take(rows).combine_chunks()
        yield from picked.to_batches()
