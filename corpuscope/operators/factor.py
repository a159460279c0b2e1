"""Factorizations of matrices with a bounded column axis.

The cross-product of the columns is summed in Spark from sparse rows; only that
square of at most MAX_AXIS columns is decomposed in one place, and coordinates of
the rows, which may be all documents, are joined and summed in Spark again.
Axes are signed so that the largest loading is positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import MAX_AXIS


def cross_product(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """``(i, j, g)`` with i <= j: sums over rows of products of two columns.

    A row has at most MAX_AXIS cells; its pairs are formed in place and summed on
    the map side.
    """
    if cells.select(col).distinct().limit(MAX_AXIS + 1).count() > MAX_AXIS:
        raise ValueError(f"a matrix axis holds at most {MAX_AXIS} terms")
    rows = cells.groupBy(row).agg(
        F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), F.col(value).cast("double").alias("v")))).alias("r")
    )
    pairs = F.flatten(
        F.transform(
            "r",
            lambda a, k: F.transform(
                F.slice("r", k + 1, F.size("r")),
                lambda b: F.struct(a["c"].alias("i"), b["c"].alias("j"), (a["v"] * b["v"]).alias("g")),
            ),
        )
    )
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.j").agg(F.sum("p.g").alias("g"))


def _square(half: DataFrame) -> tuple[list[str], np.ndarray]:
    """A symmetric matrix given by its upper half; at most MAX_AXIS names."""
    names = [r[0] for r in half.select(F.col("i")).where("i = j").distinct().orderBy("i").limit(MAX_AXIS + 1).collect()]
    if len(names) > MAX_AXIS:
        raise ValueError(f"a matrix axis holds at most {MAX_AXIS} terms")
    pos = {n: k for k, n in enumerate(names)}
    cells = half.toPandas()
    i, j = cells["i"].map(pos).to_numpy(int), cells["j"].map(pos).to_numpy(int)
    m = np.zeros((len(names), len(names)))
    m[i, j] = cells["g"].to_numpy(float)
    m[j, i] = cells["g"].to_numpy(float)
    return names, m


def _eigen(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1][:k]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def _loadings(spark, names: list[str], matrix: np.ndarray, **more: np.ndarray) -> DataFrame:
    """``(col, axis, loading, ...)`` of at most MAX_AXIS names by k axes."""
    n, k = matrix.shape
    data = {
        "col": np.repeat(np.array(names, dtype=object), k),
        "axis": np.tile(np.arange(k), n),
        "loading": matrix.ravel(),
        **{name: m.ravel() for name, m in more.items()},
    }
    return spark.createDataFrame(pd.DataFrame(data)).withColumn("axis", F.col("axis").cast("int"))


def _axis_table(spark, values: np.ndarray, total: float) -> DataFrame:
    return spark.createDataFrame(
        [(k, float(v), float(np.sqrt(v)), float(v / total) if total else 0.0) for k, v in enumerate(values)],
        "axis int, eigenvalue double, singular_value double, explained double",
    )


def _project(cells: DataFrame, row: str, col: str, weight: Column, loadings: DataFrame) -> DataFrame:
    """``(row, axis, value)``: rows of the matrix times the loadings."""
    table = F.broadcast(loadings.select(F.col("col").alias(col), "axis", "loading"))
    return (
        cells.join(table, col)
        .groupBy(row, "axis")
        .agg(F.sum(weight * F.col("loading")).alias("value"))
    )


def svd(cells: DataFrame, row: str, col: str, value: str, k: int = 2) -> dict[str, DataFrame]:
    """Truncated SVD: ``axes``, ``cols`` (right vectors) and ``rows`` (left vectors)."""
    spark = cells.sparkSession
    names, gram = _square(cross_product(cells, row, col, value))
    values, vectors = _eigen(gram, k)
    loadings = _loadings(spark, names, vectors)
    axes = _axis_table(spark, values, float(np.trace(gram)))
    left = _project(cells, row, col, F.col(value), loadings).join(
        F.broadcast(axes.where("singular_value > 0")), "axis"
    )
    return {
        "axes": axes,
        "cols": loadings.select(F.col("col").alias(col), "axis", F.col("loading").alias("value")),
        "rows": left.select(row, "axis", (F.col("value") / F.col("singular_value")).alias("value")),
    }


def lsa(matrix: DataFrame, k: int = 2, value: str = "tfidf") -> dict[str, DataFrame]:
    """Latent semantic analysis: terms (``terms``) and documents (``documents``) on k axes.

    ``matrix`` is ``(id, term, value)``; coordinates are vectors times singular values.
    """
    parts = svd(matrix, "id", "term", value, k)
    scaled = {
        key: parts[key].join(F.broadcast(parts["axes"]), "axis").select(
            name, "axis", (F.col("value") * F.col("singular_value")).alias("value")
        )
        for key, name in (("cols", "term"), ("rows", "id"))
    }
    return {"axes": parts["axes"], "terms": scaled["cols"], "documents": scaled["rows"]}


def pca(cells: DataFrame, row: str, col: str, value: str, k: int = 2) -> dict[str, DataFrame]:
    """Principal components of the columns: ``axes``, ``cols`` and ``rows`` (scores)."""
    spark = cells.sparkSession
    names, gram = _square(cross_product(cells, row, col, value))
    n = cells.select(row).distinct().count()
    sums = {r[0]: r[1] for r in cells.groupBy(col).agg(F.sum(value)).collect()}
    mean = np.array([float(sums[c]) for c in names]) / n
    values, vectors = _eigen((gram - n * np.outer(mean, mean)) / max(n - 1, 1), k)
    total = float(np.trace(gram - n * np.outer(mean, mean)) / max(n - 1, 1))
    loadings = _loadings(spark, names, vectors)
    offsets = spark.createDataFrame(
        [(a, float(x)) for a, x in enumerate(mean @ vectors)], "axis int, offset double"
    )
    scores = _project(cells, row, col, F.col(value), loadings).join(F.broadcast(offsets), "axis")
    return {
        "axes": _axis_table(spark, values, total),
        "cols": loadings.select(F.col("col").alias(col), "axis", F.col("loading").alias("value")),
        "rows": scores.select(row, "axis", (F.col("value") - F.col("offset")).alias("value")),
    }


def correspondence_analysis(
    cells: DataFrame, row: str, col: str, value: str, k: int = 2
) -> dict[str, DataFrame]:
    """Correspondence analysis: ``axes`` and standard, principal coordinates and scores.

    The trivial axis is taken out of the cross-product of the scaled profiles, so
    the table of residuals, which is dense, is never formed.
    """
    spark = cells.sparkSession
    cells = cells.select(row, col, F.col(value).cast("double").alias("x"))
    total = cells.agg(F.sum("x")).first()[0]
    col_mass = {r[0]: r[1] / total for r in cells.groupBy(col).agg(F.sum("x")).limit(MAX_AXIS + 1).collect()}
    col_table = F.broadcast(spark.createDataFrame(list(col_mass.items()), f"`{col}` {dict(cells.dtypes)[col]}, _c double"))
    row_table = cells.groupBy(row).agg((F.sum("x") / total).alias("_r"))
    scaled = (
        cells.join(row_table, row)
        .join(col_table, col)
        .withColumn("s", F.col("x") / total / F.sqrt(F.col("_r") * F.col("_c")))
    )
    names, gram = _square(cross_product(scaled, row, col, "s"))
    mass = np.array([col_mass[c] for c in names])
    residual = gram - np.outer(np.sqrt(mass), np.sqrt(mass))
    inertia = float(np.trace(residual))
    values, vectors = _eigen(residual, k)
    sigma = np.sqrt(values)
    standard = vectors / np.sqrt(mass)[:, None]
    principal = standard * sigma
    spread = np.clip(np.diag(residual) / mass, 1e-15, None)
    cols = _loadings(spark, names, standard, principal=principal, score=principal**2 / spread[:, None])
    right = _loadings(spark, names, vectors)
    axes = _axis_table(spark, values, inertia)
    lengths = scaled.groupBy(row).agg(
        F.first("_r").alias("_r"), (F.sum(F.col("s") * F.col("s")) / F.first("_r") - 1).alias("_d")
    )
    rows = (
        _project(scaled, row, col, F.col("s"), right)
        .join(lengths, row)
        .join(F.broadcast(axes), "axis")
        .withColumn("principal", F.col("value") / F.sqrt("_r"))
    )
    return {
        "axes": axes,
        "cols": cols.select(F.col("col").alias(col), "axis", F.col("loading").alias("standard"), "principal", "score"),
        "rows": rows.select(
            row,
            "axis",
            F.try_divide("principal", F.col("singular_value")).alias("standard"),
            "principal",
            F.try_divide(F.col("principal") * F.col("principal"), F.col("_d")).alias("score"),
        ),
    }


def mds(dissim: DataFrame, k: int = 2) -> DataFrame:
    """``(term, axis, value)``: classical scaling of a full ``(t1, t2, value)`` matrix.

    Squared dissimilarities are centred by their row and column means in Spark.
    """
    squared = dissim.select("t1", "t2", (F.col("value") * F.col("value")).alias("d"))
    means = squared.groupBy("t1").agg(F.avg("d").alias("m"))
    grand = means.agg(F.avg("m")).scalar()
    centred = (
        squared.join(F.broadcast(means), "t1")
        .join(F.broadcast(means.toDF("t2", "m2")), "t2")
        .select(
            F.col("t1").alias("i"),
            F.col("t2").alias("j"),
            (-0.5 * (F.col("d") - F.col("m") - F.col("m2") + grand)).alias("g"),
        )
        .where("i <= j")
    )
    names, b = _square(centred)
    values, vectors = _eigen(b, k)
    return _loadings(dissim.sparkSession, names, vectors * np.sqrt(values)).select(
        F.col("col").alias("term"), "axis", F.col("loading").alias("value")
    )


def cluster_centers(coords: DataFrame, clusters: DataFrame, item: str = "term") -> DataFrame:
    """``(cluster, axis, value)``: mean coordinates per cluster."""
    return coords.join(clusters, item).groupBy("cluster", "axis").agg(F.avg("value").alias("value"))
