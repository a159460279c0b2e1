"""Record, term and cluster filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import doc_terms, items
from ..plans.skew import skew_join

LAST_ZONE = 3


@dataclass(frozen=True)
class RecordFilter:
    """Bounds applied to a corpus before an analysis; ``None`` leaves a column alone."""

    years: tuple[int, int] | None = None
    citations: tuple[int, int] | None = None
    bradford_law_zone: int | None = None
    document_types: Sequence[str] | None = None
    cluster: str | None = None


def filter_records(
    df: DataFrame, bounds: RecordFilter, clusters: DataFrame | None = None
) -> DataFrame:
    """Apply a record filter.

    ``clusters`` is a table ``(cluster, id)``, needed when ``bounds.cluster`` is set.
    """
    if bounds.years is not None:
        df = df.where(F.col("year").between(*bounds.years))
    if bounds.citations is not None:
        df = df.where(F.col("global_citations").between(*bounds.citations))
    if bounds.bradford_law_zone is not None:
        zone = F.coalesce("bradford_law_zone", F.lit(LAST_ZONE))
        df = df.where(zone <= bounds.bradford_law_zone)
    if bounds.document_types is not None:
        df = df.where(F.col("document_type").isin(list(bounds.document_types)))
    if bounds.cluster is not None:
        members = clusters.where(F.col("cluster") == bounds.cluster).select("id")
        df = df.join(members, "id", "left_semi")
    return df


def filter_bounds(df: DataFrame) -> DataFrame:
    """The widest record filter of a corpus, in one row."""
    return df.agg(
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.min("global_citations").alias("min_citations"),
        F.max("global_citations").alias("max_citations"),
        F.array_sort(F.collect_set("document_type")).alias("document_types"),
    )


def years_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("year").between(first, last))


def select_types(df: DataFrame, types: Sequence[str]) -> DataFrame:
    return df.where(F.col("document_type").isin(list(types)))


def exclude_terms(dt: DataFrame, stop_terms: DataFrame) -> DataFrame:
    """Drop the stop terms, a table ``(term)``, from a relation with a ``term`` column."""
    return skew_join(dt, stop_terms.select("term").distinct(), "term", "left_anti")


def limit_terms(
    dt: DataFrame,
    limit_to: Mapping[str, Sequence[str]] | None = None,
    exclude: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Keep (``limit_to``) or drop (``exclude``) the listed values of each named column."""
    for col, values in (limit_to or {}).items():
        df_filter = F.col(col).isin(list(values))
        dt = dt.where(df_filter)
    for col, values in (exclude or {}).items():
        dt = dt.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))
    return dt


def corpus_filter(df: DataFrame, col: str, clusters: DataFrame, cluster: str) -> DataFrame:
    """Documents holding any term of a cluster; ``clusters`` is ``(cluster, term)``."""
    terms = clusters.where(F.col("cluster") == cluster).select("term")
    hits = skew_join(doc_terms(df, col), terms, "term", "left_semi").select("id")
    return df.join(hits, "id", "left_semi")


def occurrence_bounds(
    counters: DataFrame, min_occ: int | None = 1, max_occ: int | None = None
) -> DataFrame:
    """Terms in at least ``min_occ`` and fewer than ``max_occ`` documents."""
    if min_occ is not None and min_occ > 1:
        counters = counters.where(F.col("num_documents") >= min_occ)
    if max_occ is not None:
        counters = counters.where(F.col("num_documents") < max_occ)
    return counters


def min_terms_per_doc(dt: DataFrame, minimum: int) -> DataFrame:
    """Rows of the documents that keep at least ``minimum`` terms."""
    rich = dt.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return dt.join(rich.select("id"), "id", "left_semi")


def documents_for_term(df: DataFrame, col: str, term: str) -> DataFrame:
    """Documents holding a term, most cited first."""
    return df.where(F.array_contains(items(df, col), term)).orderBy(
        F.col("global_citations").desc(), "title", "id"
    )


def co_present_values(df: DataFrame, a: str, value_a: str, b: str) -> DataFrame:
    """Values of column ``b`` in the documents that hold ``value_a`` in column ``a``."""
    hits = df.where(F.array_contains(items(df, a), value_a))
    return doc_terms(hits, b).select("term").distinct()


def documents_for_pair(df: DataFrame, a: str, value_a: str, b: str, value_b: str) -> DataFrame:
    """Documents holding both values, most cited first."""
    return documents_for_term(df.where(F.array_contains(items(df, a), value_a)), b, value_b)
