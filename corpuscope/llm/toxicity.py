"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over words and their first four bytes (words are runs of
letters, A-Z in lower case), so that a stem is seen under any ending.  Every term of
every example is in use, with its document frequency in all documents; a term that no
example has counts in the length of a text's vector only.  A term weighs the more, the
better it tells toxic from clean examples: its IDF is multiplied by the root of one plus
its chi-square statistic.  (Without that factor the neighbours share small talk, and a quarter
to a half of the held-out toxic texts is missed.)

The examples stand in an inverted index in blocks, with the largest weight of every
frequent term in each block.  A text's similarity to a block's members is at most the
product of its vector with those maxima plus the largest sum over the other terms, so
blocks whose bound does not reach the k-th best cosine are skipped: the neighbours are
exact.  Their votes, weighted by closeness, are calibrated on the examples themselves
(each left out of its own vote).

The examples are a sample of the labelled rows that is bounded in rows and bytes, so the
index is broadcast; terms are counted and vectors packed in tasks, and texts are scored
where they are read, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, mix, range_hashes, runs, slices, texts
from .packed import changes, from_planes, planes
from .storage import partitions, stored

MAX_EXAMPLES = 16_384
BLOCK = 64
NEIGHBOURS = 15
#: Bytes of the texts of all examples together.
MAX_BYTES = 1 << 28
#: So many of the most frequent terms are held as dense columns, the others as postings.
_DENSE = 1_024
#: So many of those are summed in double precision in the end, the others as postings are.
_DOUBLE = 512
#: Bytes of the beginning of a word that is a term too.
_STEM = 4
#: Terms whose document frequencies travel in one row.
_SLOT = 1 << 16
#: Text that is scored at once, beside the index.
_SLICE_BYTES = 1 << 20
_SEEDS = 16
#: Blocks in a row that are read in one product.
_TOGETHER = 16
_BATCH = 192
#: Most bits of a code that look up its place: 16 MB.
_PLACE_BITS = 22
#: Postings that are summed at once.
_POSTINGS = 1 << 18

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[ord("a") : ord("z") + 1] = True
_LETTERS[128:] = True


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of their first bytes, text by text, and where each text's begin."""
    low = LOWER[data]
    starts, ends = runs(_LETTERS[low], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    long = np.flatnonzero(ends - starts >= _STEM)
    first = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts[long]].view("<u8")[:, 0]
    stems = mix(mix(first & np.uint64((1 << 8 * _STEM) - 1)) + np.uint64(_STEM))
    whole = np.searchsorted(starts, offsets)
    cut = np.searchsorted(long, whole)
    # The words of a text lie before its stems.
    out = np.empty(len(starts) + len(long), np.uint64)
    out[np.arange(len(starts)) + np.repeat(cut[:-1], np.diff(whole))] = range_hashes(low, starts, ends)
    out[np.arange(len(long)) + np.repeat(whole[1:], np.diff(cut))] = stems
    return out, whole + cut


def _counts(data: np.ndarray, offsets: np.ndarray):
    """Row, code and count of the terms in each text, by row and code."""
    codes, bounds = _codes(data, offsets)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        codes[lo:hi].sort()
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(changes(rows, codes))
    return rows[at], codes[at], np.diff(np.append(at, len(codes)))


class Postings:
    """Weights of examples by term: those of a term are ``bounds[t]:bounds[t + 1]``."""

    def __init__(self, n: int, often: np.ndarray):
        """Room for ``often`` weights of each term."""
        self.n = n
        self.bounds = np.concatenate([[0], np.cumsum(often)])
        # A row and its weight lie side by side, so that one copy fetches both.
        self.pairs = np.zeros((self.bounds[-1], 2), np.uint32)
        self.rows, self.weights = self.pairs[:, 0], self.pairs[:, 1].view(np.float32)
        self._next = self.bounds[:-1].copy()
        self._room = None

    def add(self, row: int, terms: np.ndarray, weights: np.ndarray) -> None:
        at = self._next[terms]
        self.rows[at], self.weights[at] = row, weights
        self._next[terms] += 1

    def sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Product of a vector with every example."""
        if self._room is None:
            # No term has more postings than there are examples.
            most = max(_POSTINGS, self.n)
            self._room = np.empty(most, np.uint64), np.empty(most, np.int64), np.empty(most)
        fetched, rows, parts = self._room
        lows, lengths = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        ends = np.cumsum(lengths)
        pairs, weights = self.pairs.reshape(-1).view(np.uint64), weights.astype(np.float32)
        out = None
        at = 0
        while at < len(terms):
            before = int(ends[at] - lengths[at])
            after = int(np.searchsorted(ends, before + len(fetched), side="right"))
            n = int(ends[after - 1]) - before
            spans = zip(lows[at:after].tolist(), (lows + lengths)[at:after].tolist())
            np.concatenate([pairs[lo:hi] for lo, hi in spans], out=fetched[:n])
            both = fetched[:n].view(np.uint32).reshape(-1, 2)
            rows[:n] = both[:, 0]
            np.multiply(both[:, 1].view(np.float32), np.repeat(weights[at:after], lengths[at:after]), out=parts[:n])
            some = np.bincount(rows[:n], parts[:n], minlength=self.n)
            out = some if out is None else out + some
            at = after
        return np.zeros(self.n) if out is None else out


class BlockMaxIndex:
    """Unit vectors of labelled examples in blocks with their largest weights.

    ``vectors`` is a matrix, or a list of the terms and weights of each example, which
    is emptied, and ``width`` the number of terms.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors, width: int | None = None):
        n = len(ids)
        if not isinstance(vectors, list):
            width = vectors.shape[1]
            vectors = [(t := np.flatnonzero(v), v[t]) for v in vectors]
        self.width = width
        order = self._order(vectors, width)
        self.ids, self.labels = ids[order], labels[order]
        often = np.zeros(width, np.int64)
        for terms, _ in vectors:
            often[terms] += 1
        frequent = np.argsort(-often, kind="stable")[:_DENSE]
        dense = np.sort(frequent)
        self.double = np.isin(dense, frequent[:_DOUBLE])
        self.column = np.full(width, -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        self.head = np.zeros((n, len(dense)), np.float32)
        often[dense] = 0
        self.tail = Postings(n, often)
        for row, i in enumerate(order.tolist()):
            terms, weights = vectors[i]
            vectors[i] = None
            column = self.column[terms]
            within = column >= 0
            self.head[row, column[within]] = weights[within]
            self.tail.add(row, terms[~within], weights[~within])
        del self.tail._next
        self._room = np.empty((2, 0, n), np.float32)
        self.starts = np.arange(0, n, BLOCK)
        self.maxima = np.maximum.reduceat(self.head, self.starts, axis=0) if n else self.head

    @staticmethod
    def _order(vectors: list, width: int) -> np.ndarray:
        """Examples by the nearest of a few of them, so that blocks hold like ones."""
        seeds = vectors[:: max(1, len(vectors) // _SEEDS)][:_SEEDS]
        # Row 0 is for the terms that no seed has.
        slot = np.zeros(width, np.int32)
        for terms, _ in seeds:
            slot[terms] = 1
        slot = np.cumsum(slot, dtype=np.int32) * slot
        held = np.zeros((slot.max(initial=0) + 1, len(seeds)), np.float32)
        for i, (terms, weights) in enumerate(seeds):
            held[slot[terms], i] = weights
        nearest = [int((weights @ held[slot[terms]]).argmax()) for terms, weights in vectors]
        return np.argsort(np.array(nearest, np.int64), kind="stable")

    @staticmethod
    def _neighbouring(blocks: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        """First and end of runs of blocks in a row, of at most so many."""
        cuts = np.flatnonzero(np.diff(blocks) > 1) + 1
        for run in np.split(blocks, cuts):
            for i in range(0, len(run), most):
                yield int(run[i]), int(run[i : i + most][-1]) + 1

    @property
    def vectors(self) -> np.ndarray:
        """The whole matrix, for small ones."""
        out = np.zeros((len(self.ids), self.width), np.float32)
        dense = np.flatnonzero(self.column >= 0)
        out[:, dense] = self.head
        terms = np.repeat(np.arange(self.width), np.diff(self.tail.bounds))
        out[self.tail.rows, terms] = self.tail.weights
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1):
        """Positions and cosines of the ``k`` nearest examples, nearest first.

        Examples that share no term are no neighbours.  Ties go to the smaller
        position.  ``skip`` is an example to leave out, with all of its id.
        """
        return self.nearest_of([(terms, weights)], k, [skip])[0]

    def nearest_of(self, vectors: list[tuple], k: int, skips: list[int]) -> list[tuple]:
        """:meth:`nearest` of several vectors."""
        n, blocks = len(self.ids), len(self.starts)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in vectors]
        head = np.zeros((len(vectors), self.head.shape[1]), np.float32)
        # The same memory in each call: fetching as much anew costs more than filling it.
        if self._room.shape[1] < len(vectors):
            self._room = np.empty((2, len(vectors), n), np.float32)
        tail, scores = self._room[:, : len(vectors)]
        scores[:] = -1.0
        exact: list[np.ndarray] = []
        for i, (terms, weights) in enumerate(vectors):
            column = self.column[terms]
            head[i, column[column >= 0]] = weights[column >= 0]
            exact.append(self.tail.sums(terms[column < 0], weights[column < 0]))
            tail[i] = exact[-1]
        bounds = head @ self.maxima.T + np.maximum.reduceat(tail, self.starts, axis=1) + 1e-5

        def read(wanted: np.ndarray, together: int) -> None:
            some = np.flatnonzero(wanted.any(axis=0))
            for block, after in self._neighbouring(some, together):
                mine = np.flatnonzero(wanted[:, block:after].any(axis=1))
                lo, hi = block * BLOCK, min(n, after * BLOCK)
                if len(mine) == len(vectors):
                    np.add(head @ self.head[lo:hi].T, tail[:, lo:hi], out=scores[:, lo:hi])
                else:
                    scores[mine, lo:hi] = head[mine] @ self.head[lo:hi].T + tail[mine, lo:hi]
            for i, skip in enumerate(skips):
                if skip >= 0:
                    scores[i, self.ids == self.ids[skip]] = -1.0

        def kth(some: np.ndarray) -> np.ndarray:
            many = some.shape[1]
            return np.partition(some, many - k, axis=1)[:, many - k] if many >= k else np.full(len(some), -1.0)

        first = min(blocks, 1 + -(-k // BLOCK))
        wanted = np.zeros(bounds.shape, dtype=bool)
        best = np.argpartition(-bounds, first - 1, axis=1)[:, :first]
        wanted[np.arange(len(vectors))[:, None], best] = True
        read(wanted, 1)
        # The members of the most promising blocks say what the others have to reach.
        members = (best[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(len(vectors), -1)
        seen = np.take_along_axis(scores, np.minimum(members, n - 1), axis=1)
        seen[members >= n] = -1.0
        least = kth(seen)
        read((bounds >= least[:, None]) & ~wanted, _TOGETHER)
        out = []
        for i in range(len(vectors)):
            # No k-th best of all is below that of the members seen first.
            place = np.flatnonzero((scores[i] >= least[i] - 1e-5) & (scores[i] > 0))
            if len(place) > k:
                mine = scores[i, place]
                place = place[mine >= np.partition(mine, len(mine) - k)[len(mine) - k] - 1e-5]
            # The sums of a matrix product depend on its shape, so the best are summed again.
            columns = np.flatnonzero(head[i])
            double, single = columns[self.double[columns]], columns[~self.double[columns]]
            rest = (self.head[place[:, None], single] * head[i, single]).sum(axis=1, dtype=np.float64)
            cosine = (self.head[place[:, None], double].astype(np.float64) * head[i, double]).sum(axis=1)
            cosine += (exact[i][place] + rest).astype(np.float32)
            place, cosine = place[cosine > 0], cosine[cosine > 0]
            order = np.lexsort((place, -cosine))[:k]
            out.append((place[order], np.minimum(cosine[order], 1.0)))
        return out


def _increasing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing steps through the points, by pooling neighbours."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(a), float(b), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    at = np.array([b[0] for b in blocks])
    return at, np.array([b[1] / b[2] for b in blocks])


def _squeezed(numbers: np.ndarray) -> bytes | None:
    return zlib.compress(planes(numbers.astype("<u4")), 1) if len(numbers) else None


def _widened(raw: bytes | None) -> np.ndarray:
    return from_planes(zlib.decompress(raw), "<u4").astype(np.int64) if raw else np.zeros(0, np.int64)


class Terms:
    """The terms of the examples in ascending order of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self._first = None

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each code, and whether it is that of a term."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), dtype=bool)
        last = len(self.codes) - 1
        # Codes are hashes: their first bits tell the place of most of them.
        bits = min(len(self.codes).bit_length() + 1, _PLACE_BITS)
        shift = np.uint64(64 - bits)
        if self._first is None:
            self._first = np.searchsorted(self.codes >> shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        at = np.minimum(self._first[codes >> shift], last)
        late = np.flatnonzero(self.codes[at] < codes)
        at[late] = np.minimum(np.searchsorted(self.codes, codes[late]), last)
        return at.astype(np.int64), self.codes[at] == codes


class Neighbours:
    """The fitted model: terms, their weights, the index and the calibration."""

    def __init__(
        self,
        terms: Terms,
        total: np.ndarray,
        toxic: np.ndarray,
        documents: np.ndarray,
        n_documents: int,
        ids: np.ndarray,
        labels: np.ndarray,
        vectors: list[tuple[bytes, bytes]],
        k: int,
    ):
        """From the examples, toxic examples and documents with each term, and packed vectors."""
        n, t = len(ids), int(labels.sum())
        self.k, self.terms = k, terms
        expected = total * t / max(n, 1)
        chi = (toxic - expected) ** 2 * n / np.maximum(expected * (n - t) / max(n, 1) * (n - total), 1e-9)
        chi[(total == n) | (t == 0) | (t == n)] = 0
        idf = np.log((1 + n_documents) / (1 + np.minimum(documents, n_documents))) + 1e-3
        self.weight = idf * np.sqrt(1 + chi)
        #: Weight of a term that no example has.
        self.unseen = np.log((1 + max(n_documents, 1)) / 2) + 1e-3
        #: Without examples nothing speaks against a text.
        self.prior = (t + 1) / (n + 2) if n else 0.0
        none = np.array([v is None for v, _ in vectors], dtype=bool)
        #: Score of a text without any term.
        self.plain = (labels[none].sum() + self.prior) / (none.sum() + 1)
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.steps = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self._index = self._shared = None

    def shared(self, spark):
        """The model in every task; :meth:`release` ends that."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    def release(self) -> None:
        """Free what the tasks hold of the model, once what it scored is written."""
        if self._shared is not None:
            self._shared.destroy()
            self._shared = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None, "_shared": None}

    @property
    def index(self) -> BlockMaxIndex:
        """Built where it is used: the terms and their counts are a sixth of its size."""
        if self._index is None:
            vectors = []
            for steps, counts in self.vectors:
                terms = np.cumsum(_widened(steps))
                weights = np.log1p(_widened(counts)) * self.weight[terms]
                unit = weights / max(np.linalg.norm(weights), 1e-30)
                vectors.append((terms.astype(np.int32), unit.astype(np.float32)))
            self._index = BlockMaxIndex(self.ids, self.labels, vectors, len(self.weight))
        return self._index

    def settled(self) -> Neighbours:
        """The model in a task: with its index, and without what that is made of."""
        if self.index is not None:
            self.vectors = []
        return self

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        if len(votes):
            self.steps = _increasing(votes, labels.astype(float))

    def votes(self, data: np.ndarray, offsets: np.ndarray, skips: np.ndarray | None = None):
        """Row, share of toxic votes and neighbours of each text with terms.

        The prior has a small vote.  ``skips`` has an example to leave out for each text.
        """
        rows, codes, counts = _counts(data, offsets)
        at, known = self.terms.find(codes)
        weights = np.log1p(counts) * np.where(known, self.weight[at] if len(self.weight) else 0.0, self.unseen)
        cuts = np.flatnonzero(changes(rows))
        ends = np.append(cuts[1:], len(rows))
        for lo in range(0, len(cuts), _BATCH):
            vectors, skip = [], []
            for a, b in zip(cuts[lo : lo + _BATCH].tolist(), ends[lo : lo + _BATCH].tolist()):
                unit = weights[a:b] / np.linalg.norm(weights[a:b])
                vectors.append((at[a:b][known[a:b]], unit[known[a:b]].astype(np.float32)))
                skip.append(-1 if skips is None else int(skips[rows[a]]))
            found = self.index.nearest_of(vectors, self.k, skip)
            for a, (place, cosine) in zip(cuts[lo : lo + _BATCH].tolist(), found, strict=True):
                weight = 1.0 / (1.05 - cosine)
                share = (weight @ self.index.labels[place] + self.prior) / (weight.sum() + 1.0)
                yield int(rows[a]), float(share), place, cosine

    def score(self, data: np.ndarray, offsets: np.ndarray):
        """Row, calibrated score and ids, cosines and labels of the neighbours of each text with terms."""
        at, value = self.steps
        for row, share, place, cosine in self.votes(data, offsets):
            calibrated = float(np.interp(share, at, value))
            # Votes keep their order within a step.
            score = min(max(0.98 * calibrated + 0.02 * share, 0.0), 1.0)
            yield row, score, (self.index.ids[place], cosine, self.index.labels[place])


def _examples(docs, labels, id_col, text_col, label_col, max_examples, max_bytes) -> DataFrame:
    """``(doc_id, label, text)`` of the examples, one row an id."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_examples)
    )
    sample = stored(
        docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_label")
        .agg(F.min("text").alias("text"))
    )
    # A row for each of at most max_examples ids.
    before = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    within = sample.select("_id", F.sum(F.octet_length("text")).over(before).alias("_bytes")).where(
        F.col("_bytes") <= max_bytes
    )
    return sample.join(F.broadcast(within), "_id").select(
        F.col("_id").cast("bigint").alias("doc_id"), (F.col("_label") > 0).cast("int").alias("label"), "text"
    )


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, label, codes, counts)`` of ``(doc_id, label, text)``."""
    for batch in batches:
        data, offsets = texts(batch.column(2))
        for lo, hi in slices(offsets):
            rows, codes, counts = _counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cuts = pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(cuts, pa.array(codes.view(np.int64))),
                    pa.ListArray.from_arrays(cuts, pa.array(counts.astype(np.int32))),
                ],
                ["doc_id", "label", "codes", "counts"],
            )


def _document_frequencies(docs: DataFrame, text_col: str, shared, n_terms: int) -> np.ndarray:
    """Documents with each term, summed in the tasks and then by slots of terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for lo, hi in slices(offsets):
                _, codes, _ = _counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at, known = shared.value.find(codes)
                total += np.bincount(at[known], minlength=n_terms)
        parts = [total[i : i + _SLOT].tobytes() for i in range(0, n_terms, _SLOT)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], ["slot", "counts"]
        )

    def added(key, table):
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "slot int, counts binary"
    parts = docs.select(text_col).mapInArrow(counted, kind).groupBy("slot").applyInArrow(added, kind)
    found = np.zeros(n_terms, np.int64)
    for r in parts.collect():  # eight bytes a term of the examples
        here = np.frombuffer(r["counts"], np.int64)
        found[r["slot"] * _SLOT : r["slot"] * _SLOT + len(here)] = here
    return found


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = MAX_EXAMPLES,
    max_bytes: int = MAX_BYTES,
    k: int = NEIGHBOURS,
) -> Neighbours:
    """Learn from the labelled rows among ``docs``.

    ``labels`` has a row per label; repeated ids count once, as toxic if any row says
    so, with the smallest of their texts; rows with a null id or label are ignored.  Of
    more than ``max_examples`` ids, or ``max_bytes`` of text, those with the least hash
    are used.  Document frequencies are those of all ``docs``.  An empty table gives a
    model without examples, for which every text has the score 0.  The tasks hold the
    model until :meth:`Neighbours.release`.
    """
    spark = docs.sparkSession
    sample = _examples(docs, labels, id_col, text_col, label_col, max_examples, max_bytes)
    kind = "doc_id bigint, label int, codes array<bigint>, counts array<int>"
    vectors = stored(sample.mapInArrow(_vectors, kind))
    stats = (
        vectors.select("label", F.explode("codes").alias("code"))
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("label").alias("toxic"))
        .toArrow()
    )
    codes = stats.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    terms = Terms(codes[order])
    total, toxic = (stats.column(c).to_numpy()[order].astype(float) for c in ("total", "toxic"))
    shared = spark.sparkContext.broadcast(terms)
    documents = _document_frequencies(docs, text_col, shared, len(codes))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, often = [], []
            for mine, counts in zip(batch.column(2), batch.column(3), strict=True):
                at = shared.value.find(mine.values.to_numpy().view(np.uint64))[0]
                held.append(_squeezed(np.diff(at, prepend=0)))
                often.append(_squeezed(counts.values.to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(held, pa.binary()), pa.array(often, pa.binary())],
                ["doc_id", "label", "terms", "counts"],
            )

    # Packed vectors of the bounded sample; equal tables give equal models.
    kept = vectors.mapInArrow(packed, "doc_id bigint, label int, terms binary, counts binary")
    rows = kept.toArrow().sort_by("doc_id")
    ids, marks = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "label"))
    held = list(zip(rows.column("terms").to_pylist(), rows.column("counts").to_pylist(), strict=True))
    n_documents = docs.select(F.count(F.lit(1))).first()[0]
    model = Neighbours(terms, total, toxic, documents, n_documents, ids, marks, held, k)
    shared.destroy()
    model.calibrate(*_own_votes(sample, model))
    return model


def _own_votes(sample: DataFrame, model: Neighbours) -> tuple[np.ndarray, np.ndarray]:
    """Share of toxic votes of each example without its own, and its label, by id."""
    shared = model.shared(sample.sparkSession)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value.settled()
        by_id = np.argsort(fitted.index.ids, kind="stable")
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            skips = by_id[np.searchsorted(fitted.index.ids, doc, sorter=by_id)]
            data, offsets = texts(batch.column(2))
            for lo, hi in slices(offsets):
                part = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                got = [(lo + row, share) for row, share, _, _ in fitted.votes(*part, skips[lo:hi])]
                at = pa.array([row for row, _ in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([x for _, x in got], pa.float64())],
                    ["doc_id", "label", "share"],
                )

    votes = sample.repartition(partitions(sample)).mapInArrow(voted, "doc_id bigint, label int, share double")
    found = votes.toArrow().sort_by("doc_id")
    return found.column("share").to_numpy(), found.column("label").to_numpy()


def score(docs: DataFrame, model: Neighbours, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``evidence``, the nearest examples.

    All columns pass through, but for old columns of those names.  Null and empty
    texts, and texts without any term, get the share of toxic examples among such
    texts and no evidence.  Repeated rows are scored alike, and a text of any length
    whole, by itself where it is longer than a slice; an empty table stays empty.  Call
    ``model.release()`` when the result has been written.
    """
    plain = docs.drop("toxicity", "evidence")
    # The tasks still have the index from the calibration, of which only the steps are new.
    shared, steps = model.shared(docs.sparkSession), model.steps
    place = plain.columns.index(text_col)
    neighbour = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("toxic", T.IntegerType()),
        ]
    )
    schema = (
        T.StructType([*plain.schema.fields])
        .add("toxicity", T.DoubleType())
        .add("evidence", T.ArrayType(neighbour))
    )
    fields = [pa.field("doc_id", pa.int64()), pa.field("similarity", pa.float64()), pa.field("toxic", pa.int32())]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value.settled()
        fitted.steps = steps
        for batch in batches:
            data, offsets = texts(batch.column(place))
            scores = np.full(batch.num_rows, fitted.plain)
            n_near = np.zeros(batch.num_rows, np.int64)
            near: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
            for lo, hi in slices(offsets, _SLICE_BYTES):
                some = fitted.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for row, value, found in some:
                    scores[lo + row] = value
                    n_near[lo + row] = len(found[0])
                    near.append(found)  # rows come in order
            parts = [pa.array(np.concatenate(part), field.type) for part, field in zip(zip(*near), fields, strict=True)]
            evidence = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n_near)]), pa.int32()),
                pa.StructArray.from_arrays(parts, fields=fields),
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), evidence],
                [*batch.schema.names, "toxicity", "evidence"],
            )

    return plain.mapInArrow(scored, schema)


def bucket_of(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(id_col.cast("string")) % parts
