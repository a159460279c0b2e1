"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed three-byte strings (letters in lower
case, everything else a blank).  Document frequencies come from all learnable rows;
each language's centroids are clusters (spherical k-means) of a bounded sample of its
texts.  A text takes the language of the centroid with the largest cosine, and is
rejected when it is farther from it than nearly all texts that made the centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, slices, texts
from .storage import stored

BINS = 4096
CENTROIDS = 4
MAX_SAMPLE = 1024
_ROWS = 256

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[ord("a") : ord("z") + 1] = True
_LETTERS[128:] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matrix of the counts of each text's hashed three-byte strings."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    framed = np.full(len(data) + rows + 1, 0x20, dtype=np.uint8)
    low = LOWER[data]
    lead = np.flatnonzero(low == 0xC3)
    lead = lead[lead + 1 < len(low)]
    second = low[lead + 1]
    upper = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    low[upper + 1] += 0x20
    framed[np.arange(len(data)) + np.repeat(np.arange(rows), lengths) + 1] = np.where(
        _LETTERS[low], low, 0x20
    )
    if len(framed) < 3:
        return np.zeros((rows, BINS))
    codes = framed[:-2].astype(np.uint32)
    codes = (codes << np.uint32(8) | framed[1:-1]) << np.uint32(8) | framed[2:]
    bins = (codes * np.uint32(2654435761)) >> np.uint32(20)
    # Strings around a blank join two words or two texts.
    at = np.flatnonzero(framed[1:-1] != 0x20)
    row = np.searchsorted(offsets + np.arange(rows + 1), at + 1, side="right") - 1
    flat = np.bincount(row * BINS + bins[at], minlength=rows * BINS)
    return flat.reshape(rows, BINS)


def vectors(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of a matrix of counts."""
    weights = (np.log1p(matrix) * idf).astype(np.float32)
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    return np.divide(weights, norm, out=weights, where=norm > 0)


def _by_rows(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in slices(offsets):
        for a in range(lo, hi, _ROWS):
            yield a, min(a + _ROWS, hi)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of the unit vectors ``x`` and the nearest one of each.

    Starts with the vector nearest to the mean and then the farthest from those taken.
    """
    mean = x.mean(axis=0)
    picks = [int(np.argmax(x @ mean))]
    closest = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(closest)))
        closest = np.maximum(closest, x @ x[picks[-1]])
    centroids = x[picks]
    nearest = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids, nearest


class Centroids:
    """The fitted model."""

    def __init__(self, langs, idf, centroids, limits, default):
        self.langs, self.idf = langs, idf
        self.centroids, self.limits, self.default = centroids, limits, default


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    max_sample: int = MAX_SAMPLE,
    k: int = CENTROIDS,
) -> Centroids:
    """Learn from the rows of ``docs`` that have a text and a language.

    Of each language at most ``max_sample`` texts, those with the least hash of their
    id, make its ``k`` centroids.  The model holds ``k`` vectors per language.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for lo, hi in _by_rows(offsets):
                part = counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total += (part > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BINS)), pa.array(total)], ["bin", "n"]
        )

    found = (
        rows.select("text")
        .mapInArrow(presence, "bin bigint, n bigint")
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    df = np.zeros(BINS)
    for r in found:
        df[r["bin"]] = r["n"]
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    idf = np.log((1 + total) / (1 + df))
    idf[df == 0] = 0

    # A uniform hash thins out the large languages before the exact choice.
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("lang").orderBy("_unit", "doc_id")
    picked = (
        rows.select("lang", "doc_id")
        .withColumn("_unit", unit)
        .join(sizes, "lang")
        .where(F.col("_unit") * F.col("rows") <= 4.0 * max_sample)
        .withColumn("_turn", F.row_number().over(order))
        .where(F.col("_turn") <= max_sample)
        .select("lang", "doc_id")
        .distinct()
    )
    sample = rows.join(F.broadcast(picked), ["lang", "doc_id"]).select("lang", "text")

    def clustered(key, table):
        data, offsets = texts(table.column("text").combine_chunks())
        x = np.concatenate(
            [
                vectors(
                    counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), idf
                )
                for lo, hi in _by_rows(offsets)
            ]
        )
        x = x[np.lexsort(x.T[:8])]
        centroids, nearest = cluster(x, k)
        near = np.einsum("ij,ij->i", x, centroids[nearest])
        limits = [
            float(np.quantile(near[nearest == i], 0.005)) if (nearest == i).any() else 0.0
            for i in range(len(centroids))
        ]
        return pa.table(
            {
                "lang": [key[0].as_py()] * len(centroids),
                "centroid": [c.astype("<f4").tobytes() for c in centroids],
                "accepts": limits,
            }
        )

    made = (
        sample.groupBy("lang")
        .applyInArrow(clustered, "lang string, centroid binary, accepts double")
        .orderBy("lang")
        .collect()
    )
    common = sizes.orderBy(F.desc("rows"), "lang").limit(1).collect()
    return Centroids(
        [r["lang"] for r in made],
        idf,
        np.array([np.frombuffer(r["centroid"], "<f4") for r in made]).reshape(-1, BINS),
        np.array([r["accepts"] for r in made]),
        common[0]["lang"] if common else None,
    )


def identify(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """``docs`` with ``nearest_lang``, ``lang_score`` and ``lang_rejected``.

    ``nearest_lang`` is the language of the nearest centroid, or ``und`` if the text is
    null or has no letter, or if the model knows no language.  ``lang_score`` (0 to 1)
    is the language's share of the exponential cosines; 0 for ``und``.
    ``lang_rejected`` says that the text is farther from the centroid than its own
    texts were, or ``und``.  Ties go to the language that sorts first; a letter string
    that no learned text has goes to the most frequent language with score 0.  All
    columns pass through, but for old ones of those names.
    """
    new = ["nearest_lang", "lang_score", "lang_rejected"]
    plain = docs.drop(*new).withColumn(
        "_llm_letters", F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = plain.columns.index(text_col)
    schema = T.StructType(plain.schema.fields[:-1])
    schema = schema.add("nearest_lang", "string").add("lang_score", "double").add("lang_rejected", "boolean")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = sorted(set(fitted.langs))
        member = np.array([names.index(x) for x in fitted.langs], dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            letters = batch.column(n_columns).to_numpy(zero_copy_only=False)
            lang, score, reject = ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
            data, offsets = texts(batch.column(place))
            for lo, hi in _by_rows(offsets) if names else ():
                x = vectors(
                    counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]),
                    fitted.idf,
                )
                cosine = x @ fitted.centroids.T
                of_lang = np.stack([cosine[:, member == i].max(axis=1) for i in range(len(names))], 1)
                best = of_lang.argmax(axis=1)
                shares = np.exp(20.0 * (of_lang - of_lang.max(axis=1, keepdims=True)))
                shares /= shares.sum(axis=1, keepdims=True)
                own = np.where(member[None, :] == best[:, None], cosine, -1).argmax(axis=1)
                for i in np.flatnonzero(letters[lo:hi]).tolist():
                    if of_lang[i, best[i]] > 0:
                        lang[lo + i] = names[best[i]]
                        score[lo + i] = min(float(shares[i, best[i]]), 1.0)
                        reject[lo + i] = bool(cosine[i, own[i]] < fitted.limits[own[i]])
                    else:
                        lang[lo + i] = fitted.default
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_columns], pa.array(lang), pa.array(score), pa.array(reject)],
                [*batch.schema.names[:n_columns], *new],
            )

    n_columns = len(plain.columns) - 1
    return plain.mapInArrow(scored, schema)
