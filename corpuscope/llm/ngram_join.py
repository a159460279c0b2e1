"""Similarity join of word-shingle sets in prefix trees.

Which sets meet in a task is decided by an exact filter: two sets whose Jaccard
similarity is at least t differ in at most (1 - t) / (1 + t) of their summed sizes.
The shingle space is cut into one block more than that many (sizes are handled in
classes, each set also under the next smaller class), so similar sets agree in a
whole non-empty block.  A block's shingles are hashed together; sets that share a
block hash are candidates.  A passage that two texts share does not make them
candidates unless it fills a block.  Candidates meet around the smallest set of their
block, with profiles that count the shingles in parts of the hash space: sets
whose profiles differ by more than similar sets can are parted again.  What is still
connected forms a cluster.

Within a cluster the sets are stored in a trie, their shingles in one global order,
the most frequent first, so that similar sets share paths.  A walk down the trie
carries the overlap of the path with every set at once: the overlap of a shared
prefix is counted once for all sets below it.  A subtree is left when no set can
reach the threshold with what remains of its longest member.

Where very many meet, by profile or in a trie, they are dealt in parts of bounded size,
all of which hold the first set.  Most members of a group of copies are linked to it
there; the sets that are not connected with it then meet all other parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import mix, narrow, scaled, shingles, slices, texts, widen, words
from .packed import changes, doc_buckets, from_planes, planes
from .storage import deal, is_empty, partitions, stored

_U = np.uint64

#: Sets that meet in one part of a cluster in a trie, and by their much shorter profiles.
PART_SETS = 512
PROFILE_SETS = 4096
#: Bytes of shingles or profiles in one part.
PART_BYTES = 3_200_000
#: Tasks that the rows of one set are dealt to.
SALTS = 16

SIGNED = (
    "bucket int, doc_id bigint, n bigint, hi bigint, lo bigint, "
    "base bigint, count bigint, docs binary, keys binary"
)
CANDIDATES = "doc_id bigint, n bigint, hi bigint, lo bigint, other bigint, profile binary"


@cache
def size_classes(num: int, den: int, most: int = 1 << 40) -> tuple[list[int], list[int]]:
    """Least size of each class and number of blocks of each class's scheme.

    A set of class c that is similar to a smaller or equal one finds it in class c or
    c - 1.  The scheme of class c serves pairs whose smaller set is in class c.
    """
    lows, blocks = [1], []
    while lows[-1] < most:
        lows.append(max(lows[-1] + 1, _largest_partner(lows[-1], num, den) + 1))
        if len(lows) > 2:
            reach = _largest_partner(lows[-2] - 1, num, den) + 1
            lows[-1] = max(lows[-2] + 1, reach)
    for low, high in zip(lows, lows[1:], strict=False):
        del low
        a = high - 1
        b = _largest_partner(a, num, den)
        # union - intersection <= (1 - t) union and union <= (a + b) / (1 + t)
        blocks.append((a + b) * (den - num) // (den + num) + 1)
    return lows, blocks


def _largest_partner(n: int, num: int, den: int) -> int:
    """Largest size of a set that can be similar to one of ``n``."""
    return n * den // num


def block_hashes(shingle_set: np.ndarray, scheme: int, needed: int) -> np.ndarray:
    """Hashes of the non-empty blocks of a set under a scheme.

    ``needed`` blocks at most differ less one between similar sets.  Some blocks are
    added for those that stay empty; should fewer than ``needed`` be non-empty, the
    empty ones are hashed as well.
    """
    if needed == 1:
        parts = 1
    else:
        parts = needed + 1 + needed // 40
    block = scaled(shingle_set, parts)
    at = np.flatnonzero(changes(block))
    sums = np.add.reduceat(mix(shingle_set + _U(0x632BE59BD9B4E019)), at)
    found = block[at]
    keys = mix(sums + found.astype(_U) * _U(0x9FB21C651E98DF25) + _U(scheme << 33 | 1))
    if len(at) < needed:
        empty = np.setdiff1d(np.arange(parts), found).astype(_U)
        keys = np.concatenate(
            [keys, mix(mix(empty * _U(0x8CB92BA72F3D8DD7)) + _U(scheme << 33))]
        )
    return keys


def trie_links(
    sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int
) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets with den * |intersection| >= num * |union|, i < j.

    Walks a trie of the sets.  Shingles of one set only count in ``sizes``.
    """
    count = len(sets)
    if count < 2:
        return
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    _, inverse, df = np.unique(joined, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    shared = df[inverse] > 1
    ranks, owner = rank[inverse[shared]], owner[shared]
    # Posting lists by rank, and every set as ascending ranks.
    order = np.lexsort((owner, ranks))
    posting, edges = owner[order], np.searchsorted(ranks[order], np.arange(len(df) + 1))
    order = np.lexsort((ranks, owner))
    path_ranks, path_edges = ranks[order], np.searchsorted(owner[order], np.arange(count + 1))
    paths = [path_ranks[a:b] for a, b in zip(path_edges[:-1], path_edges[1:], strict=True)]
    by_path = sorted(range(count), key=lambda i: paths[i].astype(">i8").tobytes())
    lengths = np.array([len(p) for p in paths])

    def overlap_of(run: np.ndarray) -> np.ndarray:
        """Number of shingles of a run that each set holds."""
        if len(run) and run[-1] - run[0] + 1 == len(run):
            held = posting[edges[run[0]] : edges[run[-1] + 1]]
        else:
            held = np.concatenate([posting[edges[r] : edges[r + 1]] for r in run.tolist()])
        return np.bincount(held, minlength=count)

    stack = [(0, count, 0, np.zeros(count, np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        first, last = paths[by_path[lo]], paths[by_path[hi - 1]]
        same = min(len(first), len(last))
        differs = np.flatnonzero(first[depth:same] != last[depth:same])
        end = depth + int(differs[0]) if len(differs) else same
        if end > depth:
            overlap = overlap + overlap_of(first[depth:end])
        members = np.array(by_path[lo:hi])
        remaining = int(lengths[members].max()) - end
        least = int(sizes[members].min())
        bound = np.minimum(overlap + remaining, lengths)
        # den * i >= num * (a + b - i) with i at its bound and the smallest partner
        alive = bound * (den + num) >= num * (sizes + least)
        if not alive.any() or (hi - lo == 1 and alive.sum() == 1 and alive[members[0]]):
            continue
        at = lo
        while at < hi and len(paths[by_path[at]]) == end:
            i = by_path[at]
            good = overlap * (den + num) >= num * (sizes + sizes[i])
            for j in np.flatnonzero(good).tolist():
                if i < j:
                    yield i, j
            at += 1
        while at < hi:
            step = paths[by_path[at]][end]
            stop = at + 1
            while stop < hi and paths[by_path[stop]][end] == step:
                stop += 1
            stack.append((at, stop, end, overlap))
            at = stop


def profile_level(n: int) -> int:
    """Binary logarithm of the number of parts in the profile of a set of ``n``."""
    return min(max((n // 4).bit_length() - 1, 4), 16)


def profile(shingle_set: np.ndarray) -> bytes:
    """Number of shingles, 255 at most, in each part of the hash space.

    There are four to eight shingles a part, but 16 parts at least and 65,536 at most.
    """
    level = profile_level(len(shingle_set))
    counts = np.bincount(mix(shingle_set) >> _U(64 - level), minlength=1 << level)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def profile_links(profiles: list[bytes], sizes: np.ndarray, num: int, den: int):
    """Pairs of sets that their profiles do not part.

    Profiles of two sets differ by no more than the sets do, and similar sets differ by
    at most (1 - t) / (1 + t) of their summed sizes.  Profiles of different levels are
    compared after neighbouring parts of the finer one are added up.
    """
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    levels = np.array([len(profiles[i]).bit_length() - 1 for i in order])
    # Sizes ascend, so levels do; partners of a set are the sets right after it.
    for level in np.unique(levels).tolist():
        lo = int(np.searchsorted(levels, level))
        end = int(np.searchsorted(levels, level, "right"))
        most = int(sizes[end - 1]) * den // num
        stop = int(np.searchsorted(sizes, most, "right"))
        folded = np.stack(
            [
                np.frombuffer(profiles[i], np.uint8).reshape(1 << level, -1).sum(axis=1, dtype=np.int16)
                for i in order[lo:stop]
            ]
        )
        for i in range(lo, end):
            last = int(np.searchsorted(sizes, int(sizes[i]) * den // num, "right"))
            if last <= i + 1:
                continue
            apart = np.abs(folded[i + 1 - lo : last - lo] - folded[i - lo]).sum(axis=1, dtype=np.int64)
            near = apart * (den + num) <= (sizes[i + 1 : last] + sizes[i]) * (den - num)
            for j in np.flatnonzero(near).tolist():
                yield int(order[i]), int(order[i + 1 + j])


class _Forest:
    """Union-find over the members of one part."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _within(rows: DataFrame, group: list[str], pairs_of: Callable) -> DataFrame:
    """Links ``(cluster, a, b)`` that span what hangs together within each group of rows.

    Members of a cluster of several parts that do not hang together with its first set
    also come with a null ``b``.
    """
    names = ["cluster", "a", "b"]

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *now, parts, doc, n, load in zip(*columns, strict=True):
                if now != key:
                    yield from links(key, held)
                    key, held = now, {}
                # Rows may share an id and yet hold different sets.
                held[doc, load] = (n, parts)
        yield from links(key, held)

    def links(key, held: dict) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        members = sorted(held)
        docs = [doc for doc, _ in members]
        forest = _Forest(len(docs))
        for i in range(1, len(docs)):
            if docs[i] == docs[i - 1]:
                forest.join(i, i - 1)
        sizes = np.array([held[m][0] for m in members], dtype=np.int64)
        for i, j in pairs_of([load for _, load in members], sizes):
            forest.join(i, j)
        roots = [forest.root(i) for i in range(len(docs))]
        out = [(d, docs[r]) for d, r in zip(docs, roots, strict=True) if docs[r] != d]
        cluster = key[0]
        if held[members[0]][1] > 1 and cluster in docs:
            center = forest.root(docs.index(cluster))
            out += [(d, None) for d, r in zip(docs, roots, strict=True) if r != center]
        if out:
            a, b = zip(*out, strict=True)
            columns = [pa.array([cluster] * len(a)), pa.array(a), pa.array(b, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return (
        rows.select(*group, "parts", "doc_id", "n", "load")
        .repartition(partitions(rows), *group)
        .sortWithinPartitions(*group)
        .mapInArrow(spanned, "cluster bigint, a bigint, b bigint")
    )


def _part_count(sets: Column, octets: Column, part_sets: int) -> Column:
    """Number of parts for so many sets with loads of so many bytes."""
    return F.greatest(F.ceil(sets / part_sets), F.ceil(octets / PART_BYTES))


def _meet(members: DataFrame, pairs_of: Callable, part_sets: int) -> DataFrame:
    """Links ``(a, b)`` that connect what ``pairs_of`` links within each cluster.

    ``members`` is ``(cluster, doc_id, n, parts, load)``; a cluster is named by its
    first set.  The first set meets every part of its cluster.  Members that their part
    does not connect with it, the strays, then meet all other parts.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    is_first = F.col("doc_id") == F.col("cluster")
    dealt = members.withColumn("part", F.explode(F.when(is_first, every).otherwise(F.array(part))))
    found = stored(_within(dealt, ["cluster", "part"], pairs_of))
    links = found.where("b IS NOT NULL").select("a", "b")
    stray_ids = found.where("b IS NULL").select("cluster", F.col("a").alias("doc_id"))
    if is_empty(stray_ids):
        return links
    members = members.where("parts > 1")
    per = (
        members.join(stray_ids, ["cluster", "doc_id"], "left_semi")
        .groupBy("cluster")
        .agg(
            _part_count(F.count(F.lit(1)), F.sum(F.octet_length("load")), part_sets).alias("stray_parts")
        )
    )
    large = members.join(per, "cluster")
    each = F.sequence(F.lit(0).cast("bigint"), F.col("stray_parts") - 1)
    others = large.withColumn("part", part).withColumn("stray_part", F.explode(each))
    strays = (
        large.join(stray_ids, ["cluster", "doc_id"], "left_semi")
        .withColumn("stray_part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("stray_parts")))
        .withColumn("part", F.explode(every))
    )
    both = others.unionByName(strays)
    again = stored(_within(both, ["cluster", "part", "stray_part"], pairs_of))
    return links.unionByName(again.where("b IS NOT NULL").select("a", "b"))


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: tuple[int, int] = (80, 100),
) -> DataFrame:
    """Connected groups of texts whose shingle sets are similar.

    A text's words are its runs without ASCII white space, A-Z in lower case; its set
    is its distinct runs of ``size`` words, or the whole sequence if it has fewer.
    Texts are linked when |intersection| / |union| is at least ``threshold``
    (numerator, denominator).  Shingles are compared by 64-bit hashes.

    Returns a row per row of ``docs``: ``doc_id``, ``n_shingles`` and
    ``component_id``, the smallest id that links reach.  Texts that are null or have
    no words are linked with nothing.  Rows that share an id are one node; rows with
    a null id take no part and have a null component.  An empty table gives no rows;
    other columns are ignored.
    """
    import xxhash

    num, den = threshold
    parts = partitions(docs)
    lows, needed = size_classes(num, den)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = texts(batch.column(1))
            nodes, keys, owners = [], [], []
            for lo, hi in slices(offsets):
                hashes, bounds = words(
                    data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                )
                for doc, found in zip(ids[lo:hi], shingles(hashes, bounds, size), strict=True):
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    hi64, lo64 = np.frombuffer(digest, "<i8").tolist()
                    nodes.append((doc, len(found), hi64, lo64, profile(found)))
                    if doc is None or not len(found) or digest in seen:
                        continue
                    # Equal sets are linked by their digest; one per task is signed.
                    seen.add(digest)
                    own = int(np.searchsorted(lows, len(found), side="right")) - 1
                    for scheme in {own, max(own - 1, 0)}:
                        block = block_hashes(found, scheme, needed[scheme])
                        keys.append(block)
                        owners.append(np.full(len(block), doc, np.int64))
            rows = [
                (i % parts, doc, n, hi64, lo64, 0, 0, counts, b"")
                for i, (doc, n, hi64, lo64, counts) in enumerate(nodes)
            ]
            if keys:
                key, owner = np.concatenate(keys), np.concatenate(owners)
                order = np.argsort(key)
                key, owner = key[order], owner[order]
                cuts = np.searchsorted(scaled(key, parts), np.arange(parts + 1)).tolist()
                for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        base, packed = narrow(owner[a:b])
                        rows.append(
                            (bucket, None, None, None, None, base, b - a, packed, planes(key[a:b]))
                        )
            for i in range(0, len(rows), 5000):
                values = zip(*rows[i : i + 5000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, signed_kinds, strict=True)],
                    signed_names,
                )

    signed_names = [x.split()[0] for x in SIGNED.split(", ")]
    signed_kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.binary()]

    def split(batches: Iterator[pa.RecordBatch]):
        """Node rows as they are, then the packed records of the partition."""
        keys, owners = [], []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            packed = pa.compute.greater(table["count"], 0)
            yield from table.filter(pa.compute.invert(packed)).to_batches()
            for row in table.filter(packed).to_pylist():
                owners.append(widen(row["base"], row["docs"], row["count"]))
                keys.append(from_planes(row["keys"], "<u8"))
        if keys:
            yield np.concatenate(keys), np.concatenate(owners)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in split(batches):
            if isinstance(part, pa.RecordBatch):
                yield part
                continue
            key, owner = part
            order = np.argsort(key)
            new = changes(key[order])
            many = order[~(new & np.append(new[1:], True))]
            key, owner = key[many], owner[many]
            if not len(key):
                return
            least = np.minimum.reduceat(owner, np.flatnonzero(changes(key)))
            least = least[np.cumsum(changes(key)) - 1]
            apart = owner != least
            pairs = np.stack([owner[apart], least[apart]], axis=1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[changes(pairs[:, 0], pairs[:, 1])]
            a, b = pairs[:, 0], pairs[:, 1]
            bucket = doc_buckets(a, parts)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                some = order[lo:hi]
                base, packed = narrow(a[some])
                keys = planes(b[some].astype("<u8"))
                rows.append(
                    (int(bucket[some[0]]), None, None, None, None, base, len(some), packed, keys)
                )
            for i in range(0, len(rows), 500):
                values = zip(*rows[i : i + 500], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, signed_kinds, strict=True)], signed_names
                )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CANDIDATES.split(", ")]
        for part in split(batches):
            if isinstance(part, pa.RecordBatch):
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names[:4]), none, part.column("docs")], names
                )
                continue
            b, a = part
            order = np.lexsort((b, a))
            a, b = a[order], b[order].astype(np.int64)
            once = changes(a, b)
            a, b = a[once], b[once]
            for i in range(0, len(a), 50_000):
                none = pa.nulls(len(a[i : i + 50_000]), pa.int64())
                ends = pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])
                blank = pa.nulls(len(none), pa.binary())
                yield pa.RecordBatch.from_arrays([ends[0], none, none, none, ends[1], blank], names)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in slices(offsets):
                hashes, bounds = words(
                    data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                )
                sets = shingles(hashes, bounds, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        batch.column(3).slice(lo, hi - lo),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["doc_id", "cluster", "n", "parts", "load"],
                )

    signatures = deal(chosen.mapInArrow(signed, SIGNED), "bucket")
    matches = deal(signatures.mapInArrow(matched, SIGNED), "bucket")
    table = stored(matches.mapInArrow(gathered, CANDIDATES))
    nodes = table.where("other IS NULL").select("doc_id", "n", "hi", "lo")
    # Equal sets: the smallest id stands for them.  Only sets that occur again are joined
    # back, each under every salt, so that a set which most rows share is dealt widely.
    named = nodes.where("n > 0 AND doc_id IS NOT NULL")
    again = (
        named.groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("hi", "lo", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    known = (
        named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(again, ["hi", "lo", "salt"], "left")
        .select("doc_id", F.coalesce("first", "doc_id").alias("first"), "n")
    )
    names = stored(known.select("doc_id", "first", "n").distinct())
    candidate = table.where("other IS NOT NULL").select(
        F.col("doc_id").alias("a"), F.col("other").alias("b")
    )
    stars = stored(
        candidate.join(names.select(F.col("doc_id").alias("a"), F.col("first").alias("fa")), "a")
        .join(names.select(F.col("doc_id").alias("b"), F.col("first").alias("fb")), "b")
        .where("fa <> fb")
        .select(F.col("fa").alias("a"), F.col("fb").alias("b"))
        .distinct()
    )
    degree = stars.groupBy("b").agg(F.count(F.lit(1)).alias("members"))
    counted = stored(stars.join(degree, "b"))
    around = counted.select(F.col("b").alias("cluster"), F.col("a").alias("doc_id"), "members").unionByName(
        counted.select(F.col("b").alias("cluster"), F.col("b").alias("doc_id"), "members").distinct()
    )
    profiles = table.where("other IS NULL AND n > 0").select("doc_id", "n", F.col("profile").alias("load"))
    near = _meet(
        around.withColumn("parts", F.ceil((F.col("members") + 1) / PROFILE_SETS))
        .join(profiles.hint("merge"), "doc_id")
        .select("cluster", "doc_id", "n", "parts", "load"),
        lambda loads, sizes: profile_links(loads, sizes, num, den),
        PROFILE_SETS,
    )
    clusters = components(near)
    sizes = (
        clusters.join(
            names.where("doc_id = first").groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n")),
            "node",
        )
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
        .select(
            "component",
            _part_count(F.col("sets"), 8 * F.col("shingles"), PART_SETS).alias("parts"),
        )
    )
    clustered = clusters.join(sizes, "component")
    members = stored(
        chosen.join(clustered.hint("merge"), F.col("doc_id") == F.col("node"))
        .select("doc_id", "text", F.col("component").alias("cluster"), "parts")
        .mapInArrow(shingled, "doc_id bigint, cluster bigint, n bigint, parts bigint, load binary")
    )
    links = _meet(
        members,
        lambda loads, sizes: trie_links([np.frombuffer(x, "<u8") for x in loads], sizes, num, den),
        PART_SETS,
    )
    found = components(links)
    first = names.join(
        found.select(F.col("node").alias("first"), "component"), "first", "left"
    ).select("doc_id", F.coalesce("component", "first").alias("component"))
    # Rows that share an id but not their set connect the groups of both.
    label = stored(components(
        first.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    ))
    return (
        nodes.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "doc_id").alias("component_id"),
        )
    )
