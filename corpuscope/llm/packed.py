"""Shuffles of many small records in few rows.

A task turns its records (a document id and up to three numbers each) into one row
per target partition that holds them as arrays.  Spark deals, spills and fetches
those rows as any others; the receiving task reads the arrays back.  A record costs
its own bytes only, and no sort of rows on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from .kernels import narrow, widen

SCHEMA = (
    "bucket int, kind int, n bigint, base bigint, docs binary, a binary, b binary, c binary"
)
_ARROW = pa.schema(
    [
        ("bucket", pa.int32()),
        ("kind", pa.int32()),
        ("n", pa.int64()),
        ("base", pa.int64()),
        ("docs", pa.binary()),
        ("a", pa.binary()),
        ("b", pa.binary()),
        ("c", pa.binary()),
    ]
)


def planes(values: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next, and so on: small numbers compress well."""
    size = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T.tobytes()


def from_planes(raw: bytes, dtype: str) -> np.ndarray:
    """Inverse of :func:`planes`."""
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype)[:, 0]


def pack_rows(
    buckets: np.ndarray, docs: np.ndarray, columns: Sequence[np.ndarray], kind: int = 0
) -> Iterator[pa.RecordBatch]:
    """Rows of records, one per bucket that occurs."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    buckets, docs = buckets[order], docs[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
    rows = []
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(buckets)], strict=True):
        base, packed = narrow(docs[lo:hi])
        raw = [planes(c[lo:hi]) for c in columns]
        raw += [b""] * (3 - len(raw))
        rows.append((int(buckets[lo]), kind, hi - lo, base, packed, *raw))
    for i in range(0, len(rows), 500):
        columns_of = zip(*rows[i : i + 500], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(columns_of, _ARROW, strict=True)], schema=_ARROW
        )


def unpack(
    batches: Iterable[pa.RecordBatch], kinds: Sequence[str]
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Documents, columns of the given numpy types, and kinds of all records of a partition."""
    docs, columns, kind = [], [[] for _ in kinds], []
    for batch in batches:
        for row in batch.to_pylist():
            docs.append(widen(row["base"], row["docs"], row["n"]))
            kind.append(np.full(row["n"], row["kind"], dtype=np.int8))
            for out, name, dtype in zip(columns, "abc", kinds, strict=False):
                out.append(from_planes(row[name], dtype))
    if not docs:
        return np.zeros(0, np.int64), [np.zeros(0, k) for k in kinds], np.zeros(0, np.int8)
    return np.concatenate(docs), [np.concatenate(c) for c in columns], np.concatenate(kind)


def doc_buckets(docs: np.ndarray, parts: int) -> np.ndarray:
    """Target partition of each document."""
    from .kernels import mix, scaled

    return scaled(mix(docs.astype(np.uint64)), parts)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Flags of the rows that start a new group in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new
