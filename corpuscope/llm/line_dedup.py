"""Repeated lines: dropped everywhere but in one document.

Line hashes are range partitioned; within a range they are sorted by hash, then
document and position, and one pass over that order finds the lines held by enough
documents and the occurrences that stay.  The result is a compressed bitmap of kept
lines per document, which is joined to the texts only to apply it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, SPACE, range_hashes, scaled, slices, texts
from .packed import SCHEMA, changes, doc_buckets, pack_rows, unpack
from .storage import deal, partitions, stored

BITMAPS = "doc_id bigint, n_dropped bigint, keep binary"


def _keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Text, line and hash of each line whose key has at least ``min_chars`` characters."""
    breaks = np.flatnonzero(data == 0x0A)
    rows = len(offsets) - 1
    row = np.sort(
        np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    )
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    per_row = np.bincount(row, minlength=rows)
    line = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    ends = np.empty(len(starts), np.int64)
    last = np.cumsum(per_row) - 1
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:]
    solid = np.flatnonzero(~SPACE[data])
    first = np.searchsorted(solid, starts)
    after = np.searchsorted(solid, ends)
    some = np.flatnonzero(after > first)
    starts, ends = solid[first[some]], solid[after[some] - 1] + 1
    row, line = row[some], line[some]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = np.flatnonzero(chars[ends] - chars[starts] >= min_chars)
    hashes = range_hashes(LOWER[data], starts[long], ends[long])
    return row[long], line[long], hashes


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    keep: str = "last",
) -> DataFrame:
    """Compressed bitmaps of the lines that stay, for documents that lose some.

    Lines end at newlines.  A line's key is the line without ASCII white space at
    its ends, A-Z in lower case.  Keys of ``min_chars`` characters or more that at
    least ``min_docs`` documents hold stay only in the document with the largest id
    (``keep="last"``) or the smallest (``keep="first"``); there all their lines stay.

    Returns ``doc_id``, ``n_dropped`` and ``keep`` (zlib-compressed bits, first line
    first; lines beyond the bits stay), one row per document that loses a line.  Rows
    that share an id count as one document and are expected to share their text.
    Null texts and ids have no keys.  An empty table gives no rows; other columns are
    ignored.
    """
    if keep not in ("first", "last"):
        raise ValueError(keep)
    parts = partitions(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = texts(batch.column(1))
            for lo, hi in slices(offsets):
                part = data[offsets[lo] : offsets[hi]]
                row, line, hashes = _keys(part, offsets[lo : hi + 1] - offsets[lo], min_chars)
                columns = [hashes, line.astype(np.uint32)]
                yield from pack_rows(scaled(hashes, parts), ids[lo + row], columns)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (hashes, line), _ = unpack(batches, ["<u8", "<u4"])
        order = np.lexsort((line, ids, hashes))
        ids, hashes, line = ids[order], hashes[order], line[order]
        group = np.cumsum(changes(hashes)) - 1
        if not len(group):
            return
        held = np.bincount(group[changes(hashes, ids)])
        ends = np.flatnonzero(np.append(changes(hashes)[1:], True))
        starts = np.flatnonzero(changes(hashes))
        stays = ids[ends] if keep == "last" else ids[starts]
        drop = (held[group] >= min_docs) & (ids != stays[group])
        yield from pack_rows(doc_buckets(ids[drop], parts), ids[drop], [line[drop]])

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (line,), _ = unpack(batches, ["<u4"])
        order = np.lexsort((line, ids))
        ids, line = ids[order], line[order]
        distinct = changes(ids, line)
        ids, line = ids[distinct], line[distinct]
        cuts = np.flatnonzero(changes(ids))
        rows = []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)]):
            bits = np.ones((int(line[hi - 1]) // 8 + 1) * 8, dtype=np.uint8)
            bits[line[lo:hi]] = 0
            rows.append((int(ids[lo]), hi - lo, zlib.compress(np.packbits(bits).tobytes())))
        kinds = [("doc_id", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())]
        for i in range(0, len(rows), 5000):
            values = zip(*rows[i : i + 5000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, (_, k) in zip(values, kinds)], [n for n, _ in kinds]
            )

    keyed = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars)).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    )
    lines = deal(keyed.mapInArrow(hashed, SCHEMA), "bucket")
    dropped = deal(lines.mapInArrow(judged, SCHEMA), "bucket")
    return stored(dropped.mapInArrow(bitmaps, BITMAPS))


def drop_lines(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the lines cut that ``bitmaps`` does not keep, and ``n_dropped``.

    Kept lines are joined by newlines.  All columns of ``docs`` pass through; null
    texts and texts without a bitmap stay as they are.
    """
    marks = bitmaps.select(
        F.col("doc_id").alias("_llm_id"),
        F.col("n_dropped").alias("n_dropped"),
        F.col("keep").alias("_llm_keep"),
    )
    plain = docs.drop("n_dropped")
    # Texts are dealt at every size of the bitmaps, which grow with them.
    joined = plain.join(marks.hint("merge"), F.col(id_col).cast("bigint") == F.col("_llm_id"), "left")

    @F.pandas_udf("string")
    def kept(text, bits):
        def one(value, raw):
            if raw is None or value is None:
                return value
            flags = np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8))
            lines = value.split("\n")
            tail = lines[len(flags) :]
            return "\n".join([x for x, f in zip(lines, flags) if f] + tail)

        import pandas as pd

        return pd.Series([one(t, b) for t, b in zip(text, bits)], dtype=object)

    return joined.select(
        *[
            kept(F.col(text_col), F.col("_llm_keep")).alias(c) if c == text_col else F.col(c)
            for c in plain.columns
        ],
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )
