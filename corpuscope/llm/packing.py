"""Hierarchical packing of tokenised documents into windows of several lengths.

Documents are cut into whole windows first; what remains of each is routed to the
tier (a power of two) that just holds it.  Every tier is then packed in windows of
its own length: a window starts with a remainder of its tier, and its gap is
filled from shorter tiers, the longest fitting remainder first; the last filler is
cut so that the window is full.  Remainders that fill no window are cut along the
tiers, so nothing is padded.  Windows of one tier are dealt to step groups of
equal token counts.

Each task packs the documents of its own input split in blocks of bounded size, so
there is no shuffle and no state that grows with the input.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, SPACE, range_hashes, runs, slices, texts

#: Tokens that a task packs together.
BLOCK_TOKENS = 1 << 21
#: Words whose tokens a task remembers.
CACHE_WORDS = 1 << 20
#: Sequence ids of one task are below this.
TASK_SEQUENCES = 1 << 40

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[ord("'")] = _ODD
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[SPACE] = _SPACE


class WordTokens:
    """Token ids of texts under a vocabulary whose tokens end with their word.

    The file is that of a ``tokenizers`` BPE model that drops white space, lowers
    case and marks the last token of a word; runs of letters, runs of other marks
    and single digits are words.  Words of Latin-1 letters and ASCII marks are found
    in the bytes and merged once each by the same ranks; every other part between
    white space, and those with an apostrophe, is left to the ``tokenizers`` library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        suffix = "</w>"
        bytes_of = {c: b for b, c in _byte_letters().items()}
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        ranks = {}
        for token, rank in self.exact.get_vocab(with_added_tokens=True).items():
            if token in special:
                continue
            end = token.endswith(suffix)
            plain = token[: -len(suffix)] if end else token
            ranks[bytes(bytes_of[c] for c in plain) + b" " * end] = rank
        self.merge = tiktoken.Encoding(
            "words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}
        )
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for token, rank in ranks.items():
            self.ends[rank] = token.endswith(b" ") and len(token) > 1
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.uint32)

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Starts, ends and hashes of the words, and which go to the library."""
        low = LOWER[data]
        kind = _CLASS[low]
        lead = np.flatnonzero(low == 0xC3)
        lead = lead[lead + 1 < len(low)]
        second = low[lead + 1]
        upper = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        low[lead[upper] + 1] += 0x20
        letter = (second != 0x97) & (second != 0xB7)
        kind[lead[letter]] = _LETTER
        kind[lead[letter] + 1] = _LETTER
        part_starts, part_ends = runs(kind != _SPACE, offsets)
        first = np.empty(len(kind), dtype=bool)
        first[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == _DIGIT
        first[part_starts] = True
        first &= kind != _SPACE
        odd_at = np.flatnonzero(kind == _ODD)
        odd_parts = np.unique(np.searchsorted(part_starts, odd_at, side="right") - 1)
        for i in odd_parts.tolist():
            first[part_starts[i] + 1 : part_ends[i]] = False
        starts = np.flatnonzero(first)
        last_of_part = np.searchsorted(starts, part_ends) - 1
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:]
        ends[last_of_part] = part_ends
        odd = np.zeros(len(starts), dtype=bool)
        odd[np.searchsorted(starts, part_starts[odd_parts])] = True
        return starts, ends, range_hashes(low, starts, ends), odd, low

    def learn(self, data, low, starts, ends, hashes, odd) -> None:
        """Remember the tokens of new words."""
        raw = low.tobytes()
        plain = np.flatnonzero(~odd)
        spans = zip(starts[plain].tolist(), ends[plain].tolist(), strict=True)
        joined = b"".join([raw[a:b] + b" " for a, b in spans]).decode()
        ids = self.merge.encode_to_numpy(joined)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        rest = np.flatnonzero(odd)
        parts = [data[starts[i] : ends[i]].tobytes().decode() for i in rest.tolist()]
        exact = [x.ids for x in self.exact.encode_batch(parts, add_special_tokens=False)]
        lengths = np.concatenate(
            [np.diff(cuts, prepend=0), np.array([len(x) for x in exact], np.int64)]
        ).astype(np.int64)
        new = np.concatenate([ids.astype(np.uint32), *[np.array(x, np.uint32) for x in exact]])
        first = len(self.tokens) + np.cumsum(lengths) - lengths
        hashes = np.concatenate([self.hashes, hashes[plain], hashes[rest]])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.starts = np.concatenate([self.starts, first])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]
        self.tokens = np.concatenate([self.tokens, new])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the range of each text."""
        import pandas as pd

        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends, hashes, odd, low = self.words(data, offsets)
        codes, unique = pd.factorize(hashes)
        if len(self.hashes) > CACHE_WORDS:
            self.forget()
        at = np.searchsorted(self.hashes, unique)
        here = at < len(self.hashes)
        here[here] = self.hashes[at[here]] == unique[here]
        if not here.all():
            where = np.empty(len(unique), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            new = where[~here]
            self.learn(data, low, starts[new], ends[new], hashes[new], odd[new])
            at = np.searchsorted(self.hashes, unique)
        lengths = self.lengths[at][codes]
        after = np.cumsum(lengths)
        index = np.arange(after[-1] if len(after) else 0)
        index += np.repeat(self.starts[at][codes] - (after - lengths), lengths)
        bounds = np.concatenate([[0], after])[np.searchsorted(starts, offsets)]
        return self.tokens[index], bounds


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remainders:
    """Remainders by length; the longest one that fits is found by bisection."""

    def __init__(self, pieces: list[tuple[int, int]]):
        self.by_length: dict[int, list[int]] = {}
        for length, piece in sorted(pieces, reverse=True):
            self.by_length.setdefault(length, []).append(piece)
        self.lengths = sorted(self.by_length)

    def __bool__(self) -> bool:
        return bool(self.lengths)

    def _take(self, i: int) -> tuple[int, int]:
        length = self.lengths[i]
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            del self.lengths[i]
        return length, piece

    def longest(self, most: int) -> tuple[int, int] | None:
        i = bisect_right(self.lengths, most)
        return self._take(i - 1) if i else None

    def shortest(self) -> tuple[int, int] | None:
        return self._take(0) if self.lengths else None

    def add(self, length: int, piece: int) -> None:
        if length not in self.by_length:
            insort(self.lengths, length)
        self.by_length.setdefault(length, []).append(piece)


def plan(lengths: list[int], window: int, shortest: int) -> list[tuple[int, list]]:
    """Windows as (tier, [(document, start, length), ...]) for documents of these lengths.

    ``window`` and ``shortest`` are powers of two.  All windows are full except that
    the last remainders, fewer tokens than ``shortest`` together, make windows of
    shorter powers of two.
    """
    windows, rest, starts = [], [], []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= window:
            windows.append((window, [(doc, start, window)]))
            start += window
        starts.append(start)
        if n > start:
            rest.append((n - start, doc))
    left = Remainders(rest)

    def use(length: int, doc: int, out: list) -> None:
        out.append((doc, starts[doc], length))
        starts[doc] += length

    total = sum(length for length, _ in rest)
    tier = window
    while left:
        while tier > total or (tier > shortest and left.lengths[-1] <= tier // 2):
            tier //= 2
        content: list = []
        gap = tier
        while gap:
            found = left.longest(gap)
            if found is None:
                length, doc = left.shortest()
                use(gap, doc, content)
                left.add(length - gap, doc)
                gap = 0
            else:
                use(*found, content)
                gap -= found[0]
        total -= tier
        windows.append((tier, content))
    return windows


def step_groups(tiers: list[int], step_tokens: int) -> list[int]:
    """A step group for each window: one tier a group, equal token counts.

    Windows of a tier are dealt in turn to the group with the fewest windows, so the
    groups of a tier differ by one window at most and hold ``step_tokens`` at most.
    """
    groups = [0] * len(tiers)
    first = 0
    for tier in sorted(set(tiers), reverse=True):
        members = [i for i, t in enumerate(tiers) if t == tier]
        count = max(1, -(-len(members) * tier // step_tokens))
        heap = [(0, g) for g in range(first, first + count)]
        for i in members:
            used, group = heapq.heappop(heap)
            groups[i] = group
            heapq.heappush(heap, (used + 1, group))
        first += count
    return groups


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier int, step_group bigint"
)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    shortest: int = 256,
    end_id: int = 2,
    step_tokens: int = 1 << 18,
) -> DataFrame:
    """Pieces of documents in windows of at most ``window`` tokens.

    One row per piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit integers), ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence, ``tier`` (length of the window) and
    ``step_group``.  A document is the ids of its text followed by ``end_id``, so a
    null or empty text has one id.  Every id lies in exactly one piece.  Windows are
    full; lengths are powers of two from ``window`` down to ``shortest``, and only
    the last few tokens of a block make shorter ones.

    Null ids stay null; repeated rows are packed each; an empty table gives no rows;
    other columns are ignored.  The result depends on how the input is split.
    ``tokenizer`` defaults to the word vocabulary of the public tokenizers.
    """
    if window & (window - 1) or shortest & (shortest - 1):
        raise ValueError("window lengths are powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        tokens = WordTokens(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() * TASK_SEQUENCES
        group = sequence
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group, ids, held, size
            windows = plan([len(x) // 4 for x in held], window, shortest)
            steps = step_groups([tier for tier, _ in windows], step_tokens)
            rows: list[tuple] = []
            for (tier, content), step in zip(windows, steps, strict=True):
                offset = 0
                for doc, start, length in content:
                    piece = held[doc][4 * start : 4 * (start + length)]
                    total = len(held[doc]) // 4
                    rows.append(
                        (ids[doc], start, length, piece, total, sequence, offset, tier, group + step)
                    )
                    offset += length
                sequence += 1
            group += max(steps, default=0) + 1
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values, kind)
                        for values, kind in zip(zip(*rows[i : i + 2000]), kinds)
                    ],
                    names,
                )
            ids, held, size = [], [], 0

        for batch in batches:
            data, offsets = texts(batch.column(1))
            keys = batch.column(0).to_pylist()
            for lo, hi in slices(offsets):
                part = data[offsets[lo] : offsets[hi]]
                found, bounds = tokens.encode(part, offsets[lo : hi + 1] - offsets[lo])
                raw, bounds = found.astype("<u4").tobytes(), (4 * bounds).tolist()
                for i in range(lo, hi):
                    ids.append(keys[i])
                    held.append(raw[bounds[i - lo] : bounds[i - lo + 1]] + end)
                    size += len(held[-1]) // 4
                    if size >= BLOCK_TOKENS:
                        yield from flush()
        yield from flush()

    names = [x.split()[0] for x in PIECES.split(", ")]
    i8 = pa.int64()
    kinds = [i8, i8, i8, pa.binary(), i8, i8, i8, pa.int32(), i8]
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, PIECES)
