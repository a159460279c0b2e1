"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Everything here runs inside a task on one slice of one Arrow batch.  Memory is a
small multiple of the slice, which is 4 MB of text or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
_PIECE = 1 << 19
_SHORT = 32
_SEED = 0x2545F4914F6CDD1D

_U = np.uint64
_MASK = (1 << 64) - 1
#: Odd, so that it has an inverse, and 5 modulo 8, so that its powers have a long period.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(
    0, _MASK, size=256, dtype=_U, endpoint=True
)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Masks that keep the first 0 to 8 bytes of a number.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)

_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        factors = np.full(max(n, _PIECE + 1024), base, dtype=_U)
        factors[0] = 1
        have = _tables[name] = np.multiply.accumulate(factors)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


class Rolling:
    """Hashes of any byte range of a piece of text."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = _powers("inverse", _INVERSE, n + 1)
        terms = _BYTE[data]
        terms *= _powers("power", _BASE, n + 1)[:n]
        self.sums = np.empty(n + 1, dtype=_U)
        self.sums[0] = 0
        np.cumsum(terms, out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hash of each range [start, end)."""
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def windows(self, length: int) -> np.ndarray:
        """Unmixed hash of the window of ``length`` bytes at every position."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=_U)
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the ascending, disjoint ranges.

    Ranges of up to 32 bytes are mixed eight bytes at a time, one round for all of them;
    the mixing is no polynomial, so no pattern of bytes makes it collide.  Longer ranges
    go through XXH3.
    """
    lengths = ends - starts
    out = np.empty(len(starts), dtype=_U)
    long = np.flatnonzero(lengths > _SHORT)
    whole = memoryview(np.ascontiguousarray(data))
    for i, lo, hi in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
        out[i] = xxhash.xxh3_64_intdigest(whole[lo:hi], _SEED)
    rows = np.flatnonzero(lengths <= _SHORT)
    for i in range(0, len(rows), _PIECE):
        out[rows[i : i + _PIECE]] = _short_hashes(data, starts[rows[i : i + _PIECE]], lengths[rows[i : i + _PIECE]])
    return out


def _short_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=_U)
    lo, hi = int(starts[0]), int(starts[-1] + lengths[-1])
    padded = np.zeros(hi - lo + _SHORT, np.uint8)
    padded[: hi - lo] = data[lo:hi]
    words = np.lib.stride_tricks.as_strided(padded, (hi - lo + _SHORT - 8, 8), (1, 1))
    starts = starts - lo
    # The length goes in first, so that zero bytes and the end of a range differ.
    state = mix(lengths.astype(_U) + _U(_SEED))
    here = np.arange(len(starts))
    for at in range(0, _SHORT, 8):
        here = here[lengths[here] > at] if at else here
        if not len(here):
            break
        left = np.minimum(lengths[here] - at, 8).astype(_U)
        chunk = words[starts[here] + at].view("<u8")[:, 0]
        chunk = chunk & _KEPT[left]
        state[here] = mix(state[here] ^ chunk) * _U(0x9E3779B97F4A7C15)
    return mix(state)


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; runs end with their text."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = flags[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = flags[1:]
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and, for each text, the range of its words."""
    data = LOWER[data]
    starts, ends = runs(~SPACE[data], offsets)
    return range_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The set of word shingles of each text, ascending.

    A text with fewer words than ``size`` has one shingle, its whole sequence; a
    text without words has none.
    """
    factors = [_U(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(size)]
    n = len(hashes)
    sums = np.zeros(max(n - size + 1, 0), dtype=_U)
    for i, factor in enumerate(factors):
        sums += hashes[i : i + len(sums)] * factor
    sums = mix(sums)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            mine = np.sort(sums[lo : hi - size + 1])
            keep = np.empty(len(mine), dtype=bool)
            keep[0] = True
            np.not_equal(mine[1:], mine[:-1], out=keep[1:])
            out.append(mine[keep])
        elif hi > lo:
            few = (hashes[lo:hi] * np.array(factors[: hi - lo], dtype=_U)).sum(dtype=_U)
            out.append(mix(np.array([few + _U(hi - lo)], dtype=_U)))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def scaled(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Number of the equal part of the 64-bit range that holds each hash."""
    return (((hashes >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def narrow(ids: np.ndarray) -> tuple[int, bytes]:
    """Ids as a base and offsets of four bytes if they fit, else of eight."""
    if not len(ids):
        return 0, b""
    base = int(ids.min())
    wide = int(ids.max()) - base >= 1 << 32
    return base, (ids - base).astype("<u8" if wide else "<u4").tobytes()


def widen(base: int, offsets: bytes, n: int) -> np.ndarray:
    """Inverse of :func:`narrow` for ``n`` ids."""
    kind = "<u4" if len(offsets) == 4 * n else "<u8"
    return np.frombuffer(offsets, dtype=kind).astype(np.int64) + base
