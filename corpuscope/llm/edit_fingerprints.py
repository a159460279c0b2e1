"""Fingerprints of texts under edit distance.

A text is embedded by a random walk over its characters: at every step the current
character is written down and a bit, drawn once for all texts from the step and the
character, says whether the walk moves on.  Walks of texts that differ by few edits
fall into step again, so the edit distance becomes a Hamming distance between what
was written.  The walk takes three steps per character and writes blanks when it has
reached the end.

The fingerprint samples that string at steps which are the same for all texts.  Steps
have levels (level i holds every second step of level i - 1), and a text is sampled at
the level that gives it between 128 and 256 samples, so texts of any length can be
compared at the coarser of their levels.  Whole texts are walked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import mix
from .storage import partitions, stored

SAMPLES = 128
_PERIOD = 4096
_ROUND_CHARS = 4 << 20

_random = np.random.Generator(np.random.PCG64(20240307))
_MOVES = _random.integers(0, 2, size=(_PERIOD, 256), dtype=np.int64)
_MOVES[:, 0] = 0
_SYMBOL = (1 + np.arange(256) * 7 % 15).astype(np.uint8)
_SYMBOL[0] = 0
_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)

_levels: dict[str, np.ndarray] = {"levels": np.zeros(0, np.int8)}


def _level_table(steps: int) -> np.ndarray:
    """Level of each of at least so many steps: trailing zero bits of its hash."""
    have = _levels["levels"]
    if len(have) < steps:
        n = 1 << max(16, int(steps).bit_length())
        hashes = mix(np.arange(n, dtype=np.uint64) + np.uint64(0x51ED270B)) | np.uint64(1 << 40)
        low = hashes & (~hashes + np.uint64(1))
        have = _levels["levels"] = np.log2(low.astype(np.float64)).astype(np.int8)
        _levels.update({str(r): np.flatnonzero(have >= r) for r in range(41)})
    return have


def characters(text: str) -> np.ndarray:
    """Classes 1 to 255 of the code points of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return (1 + ((points * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(255)).astype(np.uint8)


def level_of(n: int) -> int:
    """Level at which a text of ``n`` characters is sampled."""
    return max(0, (3 * n // SAMPLES).bit_length() - 1)


def fingerprints(texts: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Level and samples (0 to 15, 0 is a blank) of texts given as character classes.

    All walks go in step.  Equal texts have equal fingerprints.
    """
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    # Each text is followed by one blank, on which its walk stays.
    data = np.zeros(int(lengths.sum()) + len(texts), dtype=np.uint8)
    position = np.cumsum(lengths + 1) - (lengths + 1)
    for at, i in zip(position.tolist(), order.tolist(), strict=True):
        data[at : at + len(texts[i])] = texts[i]
    final = position + lengths
    level = np.array([level_of(int(n)) for n in lengths])
    table = _level_table(int(3 * lengths.max(initial=0)) + 1)
    steps = [_levels[str(r)] for r in range(41)]
    counts = np.array(
        [np.searchsorted(steps[r], 3 * n) for r, n in zip(level.tolist(), lengths.tolist())],
        dtype=np.int64,
    )
    out = np.zeros((len(texts), int(counts.max(initial=0))), dtype=np.uint8)
    taken = np.zeros(41, dtype=np.int64)
    active = np.flatnonzero(lengths > 0)
    at = position[active]
    step = 0
    while len(active):
        # Texts are in order of length, so each level is one range of them.
        levels = level[active]
        first = np.searchsorted(-levels, -np.arange(41), side="left")
        last = np.searchsorted(-levels, -np.arange(41), side="right")
        here = [r for r in range(41) if first[r] < last[r]]
        end = step + 128
        chunk = table[step:end].tolist()
        now = np.empty(len(at), np.uint8)
        move = np.empty(len(at), np.int64)
        least = here[0]
        for j, reached in zip(range(step, end), chunk):
            np.take(data, at, out=now)
            if reached >= least:
                for r in here:
                    if r > reached:
                        break
                    if taken[r] < out.shape[1]:
                        a, b = first[r], last[r]
                        out[active[a:b], taken[r]] = now[a:b]
            for r in range(reached + 1):
                taken[r] += 1
            np.take(_MOVES[j % _PERIOD], now, out=move)
            at += move
        step = end
        going = (at < final[active]) & (3 * lengths[active] > step)
        active, at = active[going], at[going]
    found: list = [None] * len(texts)
    for row, i in enumerate(order.tolist()):
        found[i] = (int(level[row]), _SYMBOL[out[row, : counts[row]]])
    return found


def coarser(level: int, samples: np.ndarray, to: int) -> np.ndarray:
    """Samples that are left at a higher level."""
    if to <= level:
        return samples
    steps = _levels[str(level)][: len(samples)]
    return samples[_levels["levels"][steps] >= to]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of equal samples among those that are not blank in both, 0 to 1.

    Two empty texts have likeness 1, an empty and another one 0.
    """
    if not len(a[1]) or not len(b[1]):
        return 1.0 if len(a[1]) == len(b[1]) else 0.0
    level = max(a[0], b[0])
    x, y = coarser(*a, level), coarser(*b, level)
    n = max(len(x), len(y))
    x, y = np.pad(x, (0, n - len(x))), np.pad(y, (0, n - len(y)))
    shown = (x > 0) | (y > 0)
    if not shown.any():
        return 0.0
    return float(((x == y) & shown).sum() / shown.sum())


def to_text(fingerprint: tuple[int, np.ndarray]) -> str:
    """Level and samples as hexadecimal digits."""
    level, samples = fingerprint
    return f"{level:02x}" + _DIGITS[samples].tobytes().decode()


def from_text(text: str) -> tuple[int, np.ndarray]:
    """Inverse of :func:`to_text`."""
    level = int(text[:2], 16)
    digits = np.frombuffer(text[2:].encode(), np.uint8)
    # Steps up to the last sample are needed to compare; a level holds every 2**level-th.
    _level_table((len(digits) + 64) << (level + 2))
    return level, np.where(digits > 57, digits - 87, digits - 48).astype(np.uint8)


COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_EDGE = ", part int, side string, text string"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness.

    Texts follow each other in descending id; after the last comes the first.  In an
    edited text the last third of the characters (rounded down) is replaced by as many
    of the first characters of the following text, or all it has.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.  Null texts count as
    empty.  Rows with equal ids are ordered by their text; null ids come last.  An only
    row follows itself; an empty table gives no rows; other columns are ignored.
    """
    parts = partitions(docs)
    names = [x.split()[0] for x in (COMPARED + _EDGE).split(", ")]

    def rows_of(ids, texts, following) -> Iterator[pa.RecordBatch]:
        """Results for texts of which each is followed by the next, the last by ``following``."""
        codes = [characters(t) for t in [*texts, following]]
        edited_codes, digests = [], []
        for text, after, code, next_code in zip(
            texts, [*texts[1:], following], codes, codes[1:], strict=False
        ):
            third = len(code) // 3
            keep = len(code) - third
            edited_codes.append(np.concatenate([code[:keep], next_code[:third]]))
            edited = text[:keep] + after[:third]
            digests.append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
        found = fingerprints(codes + edited_codes)
        own, edits = found[: len(codes)], found[len(codes) :]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(c) for c in codes[:-1]], pa.int64()),
            pa.array(digests, pa.string()),
            pa.array([to_text(f) for f in own[:-1]], pa.string()),
            pa.array([to_text(f) for f in edits], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, edits)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ]
        nulls = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *nulls], names)

    def edge(side: str, doc, text: str) -> pa.RecordBatch:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        values = [pa.array([doc], pa.int64()), *[pa.nulls(1, k) for k in kinds[1:]]]
        rest = [pa.array([part], pa.int32()), pa.array([side]), pa.array([text])]
        return pa.RecordBatch.from_arrays([*values, *rest], names)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, started = 0, False
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if not started:
                    started = True
                    yield edge("first", doc, text)
                if size > _ROUND_CHARS:
                    yield from rows_of(ids, texts, text)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text) + 64
        if started:
            if len(ids) > 1:
                yield from rows_of(ids[:-1], texts[:-1], texts[-1])
            yield edge("last", ids[-1], texts[-1])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, after in zip(*(c.to_pylist() for c in batch.columns)):
                for out in rows_of([doc], [text], after):
                    yield out.select(names[:7])

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    done = stored(
        chosen.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(walked, COMPARED + _EDGE)
    )
    # The last text of each part that has rows is followed by the first of the next part.
    # One row a part, without its text, is put in order here.
    first = done.where("side = 'first'").select("part", F.col("text").alias("after"))
    turn = Window.orderBy("part")
    everything = Window.partitionBy()
    following = first.select("part").withColumn(
        "following", F.coalesce(F.lead("part").over(turn), F.min("part").over(everything))
    )
    pairs = (
        done.where("side = 'last'")
        .select("doc_id", "text", "part")
        .join(following, "part")
        .join(first.withColumnRenamed("part", "following"), "following")
        .select("doc_id", "text", "after")
    )
    columns = names[:7]
    return done.where("side IS NULL").select(columns).unionByName(pairs.mapInArrow(closed, COMPARED))


def near_links(
    prints: DataFrame,
    threshold: float = 0.8,
    bands: int = 16,
    width: int = 6,
    id_col: str = "doc_id",
    fingerprint_col: str = "fingerprint",
) -> DataFrame:
    """Links ``(a, b, likeness)`` between near fingerprints, by banding and verification.

    A band is ``width`` samples at steps drawn once for all; texts agree in a band at
    their common level, so each is banded at its own level and the next coarser one.
    Texts of one band bucket are compared with the leaders of the bucket, the first of
    which every text meets that is no link of an earlier leader; each text is linked to
    the first leader at least ``threshold`` alike, so a group of copies yields one link
    per copy.  Equal fingerprints are linked to the smallest id beforehand and only it
    is banded.  Rows with null ids or fingerprints take no part.
    """
    rows = prints.where(F.col(id_col).isNotNull() & F.col(fingerprint_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(fingerprint_col).alias("fp")
    )
    leaders = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    equal = rows.join(leaders, "fp").where("doc_id <> first").select(
        F.col("doc_id").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("likeness")
    )
    picks = np.random.Generator(np.random.PCG64(7)).integers(0, SAMPLES // 2, size=(bands, width))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, fps = [], [], []
            for doc, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                level, samples = from_text(fp)
                for at in (level, level + 1):
                    some = coarser(level, samples, at)
                    some = np.pad(some, (0, max(0, SAMPLES // 2 - len(some))))
                    for band, pick in enumerate(picks):
                        keys.append(f"{at}:{band}:{some[pick].tobytes().hex()}")
                        docs.append(doc)
                        fps.append(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(docs, pa.int64()), pa.array(fps)], ["key", "doc_id", "fp"]
            )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            out = []
            for now, doc, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    key, heads = now, []
                mine = from_text(fp)
                for head, other in heads:
                    alike = likeness(mine, other)
                    if alike >= threshold:
                        out.append((doc, head, alike))
                        break
                else:
                    heads.append((doc, mine))
            if out:
                a, b, alike = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(alike)], ["a", "b", "likeness"]
                )

    bucketed = leaders.select(F.col("first").alias("doc_id"), "fp").mapInArrow(
        banded, "key string, doc_id bigint, fp string"
    )
    checked = (
        bucketed.repartition(partitions(prints), "key")
        .sortWithinPartitions("key", "doc_id")
        .mapInArrow(verified, "a bigint, b bigint, likeness double")
        .distinct()
    )
    return equal.unionByName(checked)
