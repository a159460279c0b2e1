"""Which texts contain which patterns, by automata or by a filter of all patterns.

With few patterns (:func:`containment_join`), the patterns are dealt by hash to shards of bounded size and the texts to buckets.  A
task receives one shard and one bucket, sorted so that the patterns come first: it builds
an Aho-Corasick automaton of them and streams the texts through it, batch by batch.  Each
text is read once per shard, what comes out are matches, and there are no candidate pairs
whatever the patterns have in common.  A task holds one shard's automaton and one batch.

With a table of patterns that grows (:func:`contained_patterns`), a filter of the hashes of
all patterns is broadcast.  Its size is bounded; beyond some 30 million patterns it lets more
strings pass.  Each text is read once and sends the substrings that pass, which are then
joined with the patterns by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import materialise

#: Characters of patterns in one automaton, and of texts that go through one at least.
SHARD_CHARS = 1_000_000
BUCKET_CHARS = 32_000_000
#: Beyond so many shards the texts are not repeated for each.
MOST_SHARDS = 2


def token_runs(tokens: Column, width: int) -> Column:
    """All runs of ``width`` adjacent tokens, joined by spaces."""
    if width == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (width - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(F.size(tokens) >= width, runs).otherwise(F.array().cast("array<string>"))


class _Shard:
    """An automaton that takes its patterns first and texts afterwards."""

    def __init__(self) -> None:
        import ahocorasick

        self._trie = ahocorasick.Automaton()
        self._ready = False

    def add(self, pattern: str) -> None:
        self._trie.add_word(pattern, pattern)

    def found_in(self, text: str) -> list[str]:
        if not len(self._trie):
            return []
        if not self._ready:
            self._trie.make_automaton()
            self._ready = True
        return list({pattern for _, pattern in self._trie.iter(text)})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(text, patterns)`` of the texts in which the patterns before them occur."""
    held = shard = None
    for batch in batches:
        rows, found = [], []
        places, texts, values = (batch.column(c).to_pylist() for c in ("_part", "_text", "value"))
        for row, (place, is_text, value) in enumerate(zip(places, texts, values)):
            if place != held:
                held, shard = place, _Shard()
            if not is_text:
                shard.add(value)
            elif hits := shard.found_in(value):
                rows.append(row)
                found.append(hits)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column("value").take(pa.array(rows)), pa.array(found, pa.list_(pa.string()))],
                names=["text", "patterns"],
            )


def containment_join(
    texts: DataFrame,
    patterns: DataFrame,
    shard_chars: int = SHARD_CHARS,
    bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """Pairs ``(text, pattern)`` of distinct strings where the text contains the pattern.

    ``texts`` has a column ``text`` and ``patterns`` a column ``pattern``; empty
    and NULL strings never match.
    """
    spark = texts.sparkSession
    patterns = materialise(patterns.select("pattern").where("pattern <> ''").distinct())
    texts = materialise(texts.select("text").where("text <> ''").distinct())
    none = F.lit(0).cast("bigint")
    in_patterns = patterns.agg(F.coalesce(F.sum(F.length("pattern")), none)).first()[0]
    in_texts = texts.agg(F.coalesce(F.sum(F.length("text")), none)).first()[0]
    shards = 1 + in_patterns // shard_chars
    if shards > MOST_SHARDS:
        return contained_patterns(texts, patterns, ["text"])
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1 + in_texts // bucket_chars, -(-cores // shards))

    def dealt(df: DataFrame, column: str, is_text: bool) -> DataFrame:
        """Rows in each part that needs them: one shard of patterns, one bucket of texts."""
        own = F.pmod(F.xxhash64(column), F.lit(buckets if is_text else shards))
        others = F.explode(F.sequence(F.lit(0), F.lit((shards if is_text else buckets) - 1)))
        part = F.col("_other") * buckets + own if is_text else own * buckets + F.col("_other")
        return df.withColumn("_other", others).select(
            part.cast("int").alias("_part"), F.lit(is_text).alias("_text"), F.col(column).alias("value")
        )

    rows = dealt(patterns, "pattern", False).unionByName(dealt(texts, "text", True))
    found = (
        rows.repartitionById(shards * buckets, F.col("_part"))
        .sortWithinPartitions("_part", "_text")
        .mapInArrow(_scan, "text string, patterns array<string>")
    )
    return found.select("text", F.explode("patterns").alias("pattern"))


#: Bits of the filter for an entry at least, and the logarithm of its bits at most (128 MB).
ENTRY_BITS = 16
MOST_BITS = 30
_PART_BITS = 23
_SLICE_BYTES = 1 << 18

_U = np.uint64
_ODD, _MIX, _SECOND, _THIRD = (_U(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64 - 1, size=256, dtype=_U, endpoint=True)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    return x ^ (x >> _U(29))


def _covered(first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Hashes of strings of ``length`` bytes from those of the two windows that cover them."""
    return _mixed(first * _ODD + last * _SECOND + np.array([length], _U) * _THIRD)


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of the windows of ``2 * step`` bytes from those of ``step`` bytes."""
    return _mixed(h[:-step] * _ODD + h[step:])


def _bits(h: np.ndarray, parts: int, part_bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The part of the filter that an entry belongs to, and its bits there."""
    part = (h >> _U(64 - parts)) if parts else np.zeros(len(h), _U)
    return part, [(h * k) >> _U(64 - part_bits) for k in (_ODD, _SECOND, _THIRD)]


def _within(bits: np.ndarray, h: np.ndarray, parts: int, part_bits: int) -> np.ndarray:
    part, places = _bits(h, parts, part_bits)
    inside = np.ones(len(h), bool)
    for place in places:
        at = (part << _U(part_bits)) | place
        inside &= ((bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1).astype(bool)
    return inside


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows of a string column."""
    column = column.cast(pa.large_string())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SLICE_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def _class_hashes(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(step, hashes)`` of the windows of 1, 2, 4, ... bytes, while there are any."""
    h, step = _BYTE[data], 1
    while len(h) and step <= longest:
        yield step, h
        h, step = _doubled(h, step) if len(h) > step else h[:0], 2 * step


def _entries(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the patterns and of their beginnings of a power of two of bytes."""
    for batch in batches:
        for _, data, offsets in _slices(batch.column("pattern")):
            sizes = np.diff(offsets)
            for step, h in _class_hashes(data, int(sizes.max(initial=0))):
                rows = np.flatnonzero((sizes >= step) & (sizes < 2 * step))
                if not len(rows):
                    continue
                at, size = offsets[rows], sizes[rows]
                found = [_covered(h[at], h[at], step)]
                for n in np.unique(size):
                    a = at[size == n]
                    found.append(_covered(h[a], h[a + n - step], int(n)))
                found = np.unique(np.concatenate(found))
                part, _places = _bits(found, parts, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(found.view(np.int64))], names=["part", "h"]
                )


def _built(batches: Iterator[pa.RecordBatch], part_bits: int) -> Iterator[pa.RecordBatch]:
    """The bits of one part of the filter."""
    bits, held = np.zeros(max(1, (1 << part_bits) >> 3), np.uint8), None
    for batch in batches:
        h = batch.column("h").to_numpy().view(_U)
        held = batch.column("part")[0].as_py() if len(h) else held
        for place in _bits(h, 0, part_bits)[1]:
            np.bitwise_or.at(bits, place >> _U(3), _U(1).astype(np.uint8) << (place & _U(7)).astype(np.uint8))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([bits.tobytes()])], names=["part", "bits"])


def _candidates(
    data: np.ndarray, offsets: np.ndarray, together: bool, lengths: dict[int, list[int]], inside
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, length)`` of the substrings in the filter, each once a row (or once)."""
    sizes = np.diff(offsets)
    end = np.repeat(offsets[1:], sizes)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rows, starts, spans, keys = [], [], [], []
    for step, h in _class_hashes(data, max(lengths, default=0)):
        if step not in lengths:
            continue
        at = np.flatnonzero(np.arange(step, len(h) + step) <= end[: len(h)])
        whole = _covered(h[at], h[at], step)
        hit = inside(whole)
        at, whole = at[hit], whole[hit]
        for n in lengths[step]:
            a, key = at, whole
            if n > step:
                a = at[at + n <= end[at]]
                key = _covered(h[a], h[a + n - step], n)
                hit = inside(key)
                a, key = a[hit], key[hit]
            rows.append(row[a])
            starts.append(a)
            spans.append(np.full(len(a), n, np.int64))
            keys.append(key if together else _mixed(key + row[a].astype(_U) * _ODD))
    if not rows:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    first = ~pd.Series(np.concatenate(keys)).duplicated().to_numpy()
    return tuple(np.concatenate(x)[first] for x in (rows, starts, spans))


def candidates(texts: DataFrame, patterns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, found)``: which substrings of each text may be patterns, as ``array<binary>``.

    ``found`` holds every pattern (column ``pattern``) that occurs in the text (column
    ``text``) and few other strings: those that a filter of all patterns lets pass.  The
    texts are neither shuffled nor repeated, whatever the number of patterns; work grows
    with their bytes and the number of lengths that patterns of a common beginning have.
    Without ``keep`` the rows are those of whole slices of the texts.  Substrings of one
    text are told apart by their length and a hash of 64 bits.
    """
    spark = texts.sparkSession
    patterns = materialise(patterns.select("pattern").where("pattern <> ''"))
    sizes = patterns.groupBy(F.octet_length("pattern").alias("n")).count().collect()
    lengths: dict[int, list[int]] = {}
    for n in sorted(r["n"] for r in sizes):
        lengths.setdefault(1 << (n.bit_length() - 1), []).append(n)
    entries = 2 * sum(r["count"] for r in sizes)
    total = min(MOST_BITS, max(10, (ENTRY_BITS * entries).bit_length()))
    parts = max(0, total - _PART_BITS)
    part_bits = total - parts
    hashed = patterns.mapInArrow(lambda it: _entries(it, parts), "part int, h long")
    pieces = hashed.repartitionById(1 << parts, F.col("part")).mapInArrow(
        lambda it: _built(it, part_bits), "part int, bits binary"
    )
    bits = np.zeros(1 << (total - 3), np.uint8)
    size = 1 << (part_bits - 3)
    for r in pieces.toLocalIterator():
        bits[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    keep = list(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for first, data, offsets in _slices(batch.column("_text")):
                row, start, span = _candidates(
                    data, offsets, not keep, lengths, lambda h: _within(held, h, parts, part_bits)
                )
                if not len(row):
                    continue
                if not keep:
                    row = np.zeros(len(row), np.int32)
                order = np.argsort(row, kind="stable")
                row, start, span = row[order], start[order], span[order]
                ends = np.cumsum(span)
                picked = data[np.arange(ends[-1]) + np.repeat(start - (ends - span), span)]
                strings = pa.Array.from_buffers(
                    pa.binary(),
                    len(span),
                    [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(picked)],
                )
                own, begins = np.unique(row, return_index=True)
                found = pa.ListArray.from_arrays(pa.array([*begins, len(row)], pa.int32()), strings)
                kept = batch.select(keep).take(pa.array(own + first)).columns if keep else []
                yield pa.RecordBatch.from_arrays([*kept, found], names=[*keep, "found"])

    schema = T.StructType([*[texts.schema[c] for c in keep], T.StructField("found", T.ArrayType(T.BinaryType()))])
    return texts.where("text <> ''").select(*keep, F.col("text").alias("_text")).mapInArrow(scan, schema)


def contained_patterns(texts: DataFrame, patterns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, pattern)`` of the distinct patterns in each text; without ``keep`` those in any."""
    patterns = materialise(patterns.select("pattern").where("pattern <> ''").distinct())
    found = candidates(texts, patterns, keep).select(*keep, F.explode("found").alias("_found"))
    if not keep:
        found = found.distinct()
    named = patterns.withColumn("_found", F.col("pattern").cast("binary"))
    return found.join(named, "_found").select(*keep, "pattern")
