"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``window`` bytes, most significant digit first;
equal groups at that depth are exactly the repeated windows, and a suffix that is
alone in its group is dropped at once.

The first digit is taken for many suffixes together.  Every window of ``window``
bytes has an anchor, the leftmost of its ``gram``-byte strings with the least hash,
so equal windows have equal anchors at equal offsets, and the windows with one
anchor start at consecutive positions.  One record per anchor stands for that run
of suffixes:

1. records are dealt and sorted by the anchor's hash; anchors of one document leave;
2. next they are sorted by a 128-bit BLAKE2b digest of all bytes that the run spans;
   where that is equal, the runs are equal, and all but those of the smallest document
   are removed;
3. one document per distinct run remains, the leader.  The leaders' bytes are dealt by
   their anchor and their windows sorted digit by digit, eight bytes each, to the full
   depth.  A clash of anchors' hashes only puts more windows into a group.

An anchor with many leaders (the edge of a passage that many documents share) is split:
each of its windows is dealt by itself, by a hash of its bytes.  Of equal windows that a
task meets at once, it sends that of the smallest document and removes the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Rolling, mix, scaled, slices, texts
from .packed import SCHEMA, changes, doc_buckets, pack_rows, unpack
from .storage import deal, partitions, stored

_U = np.uint64
_SLICE = 1 << 20
_PLACE = (1 << 24) - 1
#: A place is a tag of the text (25 bits), a start (31 bits) and a number of starts (8 bits).
_START_BITS = 31
_START = (1 << _START_BITS) - 1

_RUN, _REMOVED, _LEADER = 0, 1, 2

#: Leaders of an anchor from which on its windows are dealt one by one.
SPLIT_LEADERS = 4096
_CHUNK = 1 << 14

PER_DOC = "doc_id bigint, removed binary, leaders binary, leader_keys binary"
SPELLED = SCHEMA + ", raw binary"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digest of each byte range."""
    whole = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(
        b"".join(
            [
                blake2b(whole[lo:hi], digest_size=16).digest()
                for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)
            ]
        ),
        "V16",
    )


def anchor_runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Row, first start, number of starts, anchor hash and span digest of each run."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(_U), np.zeros(0, "V16")
    hashes = mix(Rolling(data).windows(gram))
    ranked = (hashes & ~_U(_PLACE)) | np.arange(len(hashes), dtype=_U)
    place = (_sliding_min(ranked, window - gram + 1) & _U(_PLACE)).astype(np.int64)
    valid = np.ones(n, dtype=bool)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[max(lo, hi - window + 1) : hi] = False
    valid = valid[: len(place)]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new)
    if not len(starts):
        return none, none, none, none.astype(_U), np.zeros(0, "V16")
    stop = np.flatnonzero(np.append(valid[:-1] & ~valid[1:], valid[-1]))
    # A run ends before the next one starts or at the last valid start of its text.
    following = np.append(starts[1:], len(place))
    last = stop[np.searchsorted(stop, starts)]
    count = np.minimum(following, last + 1) - starts
    key = mix(hashes[place[starts]] + _U(1))
    span = digests(data, starts, starts + count + window - 1)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, starts - offsets[row], count, key, span


def radix_groups(windows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows that are not alone, and their group of equal windows.

    ``windows`` has one row of bytes per suffix, ``groups`` the group so far.  Each
    pass sorts by the next eight bytes within the groups and drops single suffixes.
    """
    index = np.arange(len(windows))
    depth = windows.shape[1]
    padded = np.zeros((len(windows), -(-depth // 8) * 8), dtype=np.uint8)
    padded[:, :depth] = windows
    digits = padded.view(">u8")
    group = groups
    for digit in range(-1, digits.shape[1]):
        if digit < 0:
            order = np.argsort(group, kind="stable")
            new = changes(group[order])
        else:
            values = digits[index, digit].astype(_U)
            order = np.lexsort((values, group))
            new = changes(group[order], values[order])
        index = index[order]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        index, group = index[many], group[many]
    return index, group


def spelled(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of several ranges, one after another."""
    out = []
    for i in range(0, len(begin), _CHUNK):
        size = lengths[i : i + _CHUNK]
        ahead = np.cumsum(size) - size
        at = np.repeat(begin[i : i + _CHUNK] - ahead, size) + np.arange(size.sum())
        out.append(data[at].tobytes())
    return b"".join(out)


def window_hashes(windows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes, mixed eight bytes at a time."""
    n, depth = windows.shape
    padded = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    padded[:, :depth] = windows
    state = np.zeros(n, _U)
    for digit in padded.view("<u8").T:
        state = mix(state ^ digit) * _U(0x9E3779B97F4A7C15)
    return mix(state)


def later_windows(windows: np.ndarray, groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indices of the windows that a smaller document of their group has, too."""
    index, equal = radix_groups(windows, groups)
    if not len(index):
        return index
    least = np.full(int(equal.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, equal, ids[index])
    return index[ids[index] > least[equal]]


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and step in it of each window of the runs."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _merged(ids, start, count):
    """Union of runs of starts per text: document, start and count, sorted.

    A start carries the tag of its text above ``_START_BITS``.
    """
    order = np.lexsort((start, ids))
    ids, start, count = ids[order], start[order], count[order]
    if not len(ids):
        return ids, start, count
    # Texts are laid out one after another so that one running maximum serves all.
    tag, begin = start >> _START_BITS, start & _START
    end = begin + count
    number = np.cumsum(changes(ids, tag)) - 1
    stride = int(end.max()) + 2
    reach = np.maximum.accumulate(end + number * stride)
    new = np.ones(len(ids), dtype=bool)
    new[1:] = begin[1:] + number[1:] * stride > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ids)) - 1
    return ids[at], start[at], reach[last] - number[last] * stride - begin[at]


def _per_doc(ids, start, count, lead_ids, lead_place, lead_key) -> Iterator[pa.RecordBatch]:
    """One row per document with its removed runs and its leaders."""
    ids, start, count = _merged(ids, start, count)
    runs = np.stack([start, count], axis=1).astype("<i8")
    order = np.argsort(lead_ids, kind="stable")
    lead_ids, lead_place, lead_key = lead_ids[order], lead_place[order], lead_key[order]
    docs = np.union1d(ids, lead_ids)
    lo, hi = np.searchsorted(ids, docs), np.searchsorted(ids, docs, "right")
    llo, lhi = np.searchsorted(lead_ids, docs), np.searchsorted(lead_ids, docs, "right")
    for i in range(0, len(docs), 5000):
        j = min(i + 5000, len(docs))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs[i:j], pa.int64()),
                pa.array([runs[a:b].tobytes() for a, b in zip(lo[i:j], hi[i:j])], pa.binary()),
                pa.array(
                    [lead_place[a:b].tobytes() for a, b in zip(llo[i:j], lhi[i:j])], pa.binary()
                ),
                pa.array(
                    [lead_key[a:b].tobytes() for a, b in zip(llo[i:j], lhi[i:j])], pa.binary()
                ),
            ],
            ["doc_id", "removed", "leaders", "leader_keys"],
        )


def repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    gram: int = 20,
    split_leaders: int = SPLIT_LEADERS,
) -> DataFrame:
    """Starts of windows that also start in a document with a smaller id.

    Returns ``doc_id``, ``removed`` and ``refined``: little-endian 64-bit pairs
    (first start below the text's tag, number of starts); their union counts.  One row
    per document that has any.  Rows that share an id are one document; :func:`text_tag`
    tells the places in their texts apart.  Null ids and texts take no part.
    """
    parts = partitions(docs)
    chosen = docs.where(
        F.col(id_col).isNotNull() & (F.octet_length(text_col) >= window)
    ).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = texts(batch.column(1))
            copies: list[tuple[int, int, int]] = []
            tags = np.zeros(len(ids), dtype=_U)
            keep = np.ones(len(ids), dtype=bool)
            for i, doc in enumerate(ids.tolist()):
                whole = data[offsets[i] : offsets[i + 1]]
                digest = blake2b(whole, digest_size=16).digest()
                tags[i] = text_tag(digest)
                first = seen.setdefault(digest, doc)
                if doc < first:
                    seen[digest] = doc
                elif first < doc:
                    keep[i] = False
                    copies.append((doc, int(tags[i]) << _START_BITS, len(whole) - window + 1))
            if copies:
                doc, start, count = np.array(copies, dtype=np.int64).T
                blank = np.zeros(len(doc), "V16")
                columns = [start.astype(_U), blank, count.astype(_U)]
                yield from pack_rows(doc_buckets(doc, parts), doc, columns, _REMOVED)
            out: list[tuple] = []
            held = 0
            for lo, hi in slices(offsets, _SLICE):
                rows = np.flatnonzero(keep[lo:hi]) + lo
                if not len(rows):
                    continue
                for base, piece, cuts in _pieces(data, offsets, rows, window):
                    row, start, count, key, span = anchor_runs(piece, cuts, window, gram)
                    tagged = tags[rows[row]] << _U(_START_BITS) | (start + base).astype(_U)
                    place = tagged << _U(8) | count.astype(_U)
                    out.append((ids[rows[row]], key, span, place))
                    held += len(row)
                    if held > 1 << 20:
                        yield from _flush(out, parts)
                        out, held = [], 0
            yield from _flush(out, parts)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (key, span, place), kind = unpack(batches, ["<u8", "V16", "<u8"])
        whole = kind == _REMOVED
        done, start, count = ids[whole], key[whole], place[whole]
        yield from pack_rows(doc_buckets(done, parts), done, [start, count, count], _REMOVED)
        runs = np.flatnonzero(~whole)
        ids, key, span, place = ids[runs], key[runs], span[runs], place[runs]
        del runs
        order = np.argsort(key)
        new = changes(key[order])
        many = np.flatnonzero(~(new & np.append(new[1:], True)))
        pick = order[many]
        ids, key, span, place = ids[pick], key[pick], span[pick], place[pick]
        high, low = span.view("<u8").reshape(-1, 2).T
        order = np.lexsort((ids, low, high, key))
        ids, key, place = ids[order], key[order], place[order]
        if not len(ids):
            return
        by_key, by_span = changes(key), changes(key, high[order], low[order])
        group, sub = np.cumsum(by_key) - 1, np.cumsum(by_span) - 1
        at = np.flatnonzero(by_key)
        several = (np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at))[group]
        spans = np.bincount(group[by_span])[group]
        first = ids[np.flatnonzero(by_span)][sub]
        gone = ids > first
        lead = several & (spans > 1) & ~gone
        # The last bit of a leader's key says that its anchor has many of them.
        crowd = np.add.reduceat(lead.astype(np.int64), at) > split_leaders
        key = key & ~_U(1) | crowd[group].astype(_U)
        start, count = place >> _U(8), place & _U(255)
        yield from pack_rows(
            doc_buckets(ids[gone], parts), ids[gone], [start[gone], count[gone], count[gone]], _REMOVED
        )
        yield from pack_rows(
            doc_buckets(ids[lead], parts), ids[lead], [start[lead], key[lead], count[lead]], _LEADER
        )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (start, key, count), kind = unpack(batches, ["<u8", "<u8", "<u8"])
        gone, lead = kind == _REMOVED, kind == _LEADER
        place = start[lead] << _U(8) | count[lead]
        yield from _per_doc(
            ids[gone],
            start[gone].astype(np.int64),
            count[gone].astype(np.int64),
            ids[lead],
            place,
            key[lead],
        )

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = texts(batch.column(1))
            place, key = (
                [np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in (2, 3)
            )
            row = np.repeat(np.arange(len(ids)), [len(x) for x in place])
            if not len(row):
                continue
            place, key = np.concatenate(place), np.concatenate(key)
            tags = np.array(
                [
                    text_tag(blake2b(data[lo:hi], digest_size=16).digest())
                    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)
                ],
                dtype=_U,
            )
            mine = np.flatnonzero(place >> _U(8 + _START_BITS) == tags[row])
            row, place, key = row[mine], place[mine], key[mine]
            begin = offsets[row] + (place >> _U(8) & _U(_START)).astype(np.int64)
            split = key & _U(1) == 1
            whole, parted = np.flatnonzero(~split), np.flatnonzero(split)
            for i in range(0, len(whole), _CHUNK << 4):
                at = whole[i : i + (_CHUNK << 4)]
                yield from _pack_spelled(ids[row[at]], key[at], place[at], data, begin[at], window, parts)
            for i in range(0, len(parted), _CHUNK):
                at = parted[i : i + _CHUNK]
                yield from apart(ids[row[at]], place[at], data, begin[at])

    def apart(ids, place, data, begin) -> Iterator[pa.RecordBatch]:
        """The windows of some runs one by one, the equal ones of larger documents removed."""
        owner, step = _expand((place & _U(255)).astype(np.int64))
        ids, begin = ids[owner], begin[owner] + step
        start = (place >> _U(8))[owner] + step.astype(_U)
        windows = np.lib.stride_tricks.sliding_window_view(data, window)[begin]
        key = window_hashes(windows)
        gone = later_windows(windows, key, ids)
        one = np.ones(len(gone), _U)
        for rows in pack_rows(
            doc_buckets(ids[gone], parts), ids[gone], [start[gone], one, one], _REMOVED
        ):
            yield _with_raw(rows, [b""] * rows.num_rows)
        stay = np.ones(len(ids), dtype=bool)
        stay[gone] = False
        yield from _pack_spelled(
            ids[stay], key[stay], start[stay] << _U(8) | _U(1), data, begin[stay], window, parts
        )

    def sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raw = [], []
        for batch in batches:
            for kind, text in zip(batch.column("kind").to_pylist(), batch.column("raw").to_pylist()):
                if kind == _LEADER:
                    raw.append(np.frombuffer(text, np.uint8))
            held.append(batch.drop_columns(["raw"]))
        ids, (place, key), kind = unpack(held, ["<u8", "<u8"])
        del held
        done = kind == _REMOVED
        one = np.ones(int(done.sum()), _U)
        yield from pack_rows(
            doc_buckets(ids[done], parts), ids[done], [place[done], one, one], _REMOVED
        )
        ids, place, key = ids[~done], place[~done], key[~done]
        if not len(ids):
            return
        raw = np.concatenate(raw)
        start, count = place >> _U(8), (place & _U(255)).astype(np.int64)
        begin = np.cumsum(count + window - 1) - (count + window - 1)
        # Groups are worked off in chunks; a group is bounded by split_leaders.
        order = np.argsort(key, kind="stable")
        group = np.cumsum(changes(key[order])) - 1
        through = np.cumsum(count[order])
        all_windows = np.lib.stride_tricks.sliding_window_view(raw, window)
        at = 0
        while at < len(order):
            reach = np.searchsorted(through, (through[at - 1] if at else 0) + 200_000, "right")
            stop = max(int(reach), at + 1)
            stop = int(np.searchsorted(group, group[stop - 1], "right"))
            mine, name = order[at:stop], group[at:stop]
            owner, step = _expand(count[mine])
            windows = all_windows[begin[mine][owner] + step]
            gone = later_windows(windows, name[owner], ids[mine][owner])
            doc = ids[mine][owner[gone]]
            first = start[mine][owner[gone]] + step[gone].astype(_U)
            one = np.ones(len(gone), _U)
            yield from pack_rows(doc_buckets(doc, parts), doc, [first, one, one], _REMOVED)
            at = stop

    runs = deal(chosen.mapInArrow(anchored, SCHEMA), "bucket")
    verdicts = deal(runs.mapInArrow(judged, SCHEMA), "bucket")
    first = stored(verdicts.mapInArrow(gathered, PER_DOC))
    leaders = first.where(F.octet_length("leaders") > 0).select("doc_id", "leaders", "leader_keys")
    contexts = chosen.join(leaders.hint("merge"), "doc_id").mapInArrow(fetched, SPELLED)
    found = deal(contexts, "bucket").mapInArrow(sorted_windows, SCHEMA)
    second = stored(deal(found, "bucket").mapInArrow(gathered, PER_DOC))
    return first.select("doc_id", "removed").join(
        second.select("doc_id", F.col("removed").alias("refined")), "doc_id", "full"
    )


def text_tag(digest: bytes) -> int:
    """25 bits that tell the texts of one document id apart."""
    return int.from_bytes(digest[:4], "little") >> 7


def _with_raw(batch: pa.RecordBatch, raw: list[bytes]) -> pa.RecordBatch:
    return batch.append_column("raw", pa.array(raw, pa.binary()))


def _pack_spelled(ids, key, place, data, begin, window, parts) -> Iterator[pa.RecordBatch]:
    """Rows of runs with their bytes, one per bucket of their keys."""
    bucket = scaled(key, parts)
    order = np.argsort(bucket, kind="stable")
    bucket, ids, key, place, begin = (x[order] for x in (bucket, ids, key, place, begin))
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    lengths = (place & _U(255)).astype(np.int64) + window - 1
    spell = [
        spelled(data, begin[lo:hi], lengths[lo:hi])
        for lo, hi in zip(cuts, [*cuts[1:], len(bucket)])
    ]
    at = 0
    for rows in pack_rows(bucket, ids, [place, key], _LEADER):
        yield _with_raw(rows, spell[at : at + rows.num_rows])
        at += rows.num_rows


def _pieces(data, offsets, rows, window):
    """Texts of some rows in one stretch; a text longer than a slice in overlapping ones."""
    if len(rows) == 1 and offsets[rows[0] + 1] - offsets[rows[0]] > _SLICE:
        lo, hi = int(offsets[rows[0]]), int(offsets[rows[0] + 1])
        for at in range(lo, hi - window + 1, _SLICE):
            end = min(hi, at + _SLICE + window - 1)
            yield at - lo, data[at:end], np.array([0, end - at])
        return
    lengths = offsets[rows + 1] - offsets[rows]
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    if rows[-1] - rows[0] + 1 == len(rows):
        yield 0, data[offsets[rows[0]] : offsets[rows[-1] + 1]], cuts
    else:
        yield 0, np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows]), cuts


def _flush(out: list[tuple], parts: int) -> Iterator[pa.RecordBatch]:
    if out:
        ids, key, span, place = map(np.concatenate, zip(*out))
        yield from pack_rows(scaled(key, parts), ids, [key, span, place], _RUN)


KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    gram: int = 20,
    split_leaders: int = SPLIT_LEADERS,
) -> DataFrame:
    """Texts without the bytes of windows that also start in a document with a smaller id.

    Returns per row ``doc_id``, ``n_bytes`` (of the UTF-8 text), ``n_removed``,
    ``spans`` (maximal removed byte ranges, end excluded) and ``kept`` (the remaining
    bytes, which may cut a character).  Windows are ``window`` bytes (at most 255 +
    ``gram``), do not cross documents, may overlap, and are judged on the input.

    Null text counts as empty.  Rows with a null id keep their text.  Rows that share
    an id are one document with several texts: each gets a row, loses its own spans only,
    and none repeats another.  An empty table gives no rows; other columns are ignored.
    """
    runs = repeated_runs(docs, id_col, text_col, window, gram, split_leaders)
    runs = runs.withColumnRenamed("doc_id", "_run_id")
    joined = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .join(runs.hint("merge"), F.col("doc_id") == F.col("_run_id"), "left")
        .select("doc_id", "text", "removed", "refined")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield one(batch.slice(i, 1000))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts(batch.column(1))
        removed, spans, kept = [], [], []
        for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            text = data[offsets[i] : offsets[i + 1]]
            pairs = np.frombuffer((a or b"") + (b or b""), "<i8").reshape(-1, 2)
            if len(pairs):
                tag = text_tag(blake2b(text, digest_size=16).digest())
                pairs = pairs[pairs[:, 0] >> _START_BITS == tag]
            if not len(pairs):
                removed.append(0)
                spans.append([])
                kept.append(text.tobytes())
                continue
            zero = np.zeros(len(pairs), np.int64)
            _, start, count = _merged(zero, pairs[:, 0] & _START, pairs[:, 1] + window - 1)
            ranges = [(s, min(s + c, len(text))) for s, c in zip(start.tolist(), count.tolist())]
            ranges = [(s, e) for s, e in ranges if s < e]
            edges = [0, *[x for pair in ranges for x in pair], len(text)]
            kept.append(b"".join(text[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2])))
            removed.append(sum(e - s for s, e in ranges))
            spans.append([{"start": s, "end": e} for s, e in ranges])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, kind),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )

    return joined.mapInArrow(cut, KEPT)
