"""Multi-valued columns: items of a cell, the document-term relation, merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def items(df: DataFrame, col: str, sep: str = ";") -> Column:
    """The trimmed, distinct, non-empty items of a cell; NULL when there are none.

    ``col`` is an array column or a ``sep``-separated string column.
    """
    if isinstance(df.schema[col].dataType, T.ArrayType):
        raw = F.col(col)
    elif isinstance(df.schema[col].dataType, T.StringType):
        raw = F.split(F.col(col), f"\\Q{sep}\\E", -1)
    else:
        raw = F.when(F.col(col).isNotNull(), F.array(F.col(col).cast("string")))
    clean = F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""))
    # Names the list, so that it is made once and not again for its size.
    return F.get(F.filter(F.array(clean), lambda x: F.size(x) > 0), F.lit(0))


def doc_terms(
    df: DataFrame, col: str, keep: Sequence[str] = (), outer: bool = False
) -> DataFrame:
    """The document-term relation ``(id, term, *keep)``, one row per distinct item.

    With ``outer`` a document without items keeps one row with a NULL term.
    """
    explode = F.explode_outer if outer else F.explode
    return df.select("id", *keep, explode(items(df, col)).alias("term"))


def map_items(df: DataFrame, col: str, f: Callable[[Column], Column]) -> DataFrame:
    """Apply ``f`` to each item of a cell, in place, dropping NULL results."""
    mapped = F.filter(F.transform(items(df, col), f), lambda x: x.isNotNull())
    return df.withColumn(col, F.when(F.size(mapped) > 0, mapped))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def copy_column(df: DataFrame, source: str, new: str) -> DataFrame:
    return df.withColumn(new, F.col(source))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def merge_columns(df: DataFrame, cols: Sequence[str], new: str) -> DataFrame:
    """Union of several multi-valued columns as one sorted set; NULL when empty."""
    empty = F.array().cast("array<string>")
    merged = F.array_sort(
        F.array_distinct(F.concat(*[F.coalesce(items(df, c), empty) for c in cols]))
    )
    return df.withColumn(new, F.when(F.size(merged) > 0, merged))


def merge_text(cols: Sequence[str], sep: str = " ") -> Column:
    """Concatenate text columns, skipping NULLs; NULL when all are NULL."""
    return F.when(F.coalesce(*cols).isNotNull(), F.concat_ws(sep, *cols))


def author_counts(df: DataFrame, col: str = "authors") -> DataFrame:
    """Add ``num_authors`` and ``frac_num_documents``; both 0 without authors."""
    n = F.coalesce(F.size(items(df, col)), F.lit(0))
    n = F.when(F.col(col).isNull(), 0).otherwise(F.greatest(n, F.lit(0)))
    return df.withColumns(
        {
            "num_authors": n.cast("int"),
            "frac_num_documents": F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(0.0)),
        }
    )


def first_item(df: DataFrame, col: str) -> Column:
    """First item of a cell, such as the country of the first author."""
    return F.try_element_at(items(df, col), F.lit(1))


def reduce_list(df: DataFrame, col: str) -> DataFrame:
    """Keep each item of a cell once, in order of first appearance."""
    return df.withColumn(col, items(df, col))


def normalise_blanks(df: DataFrame, zero: Sequence[str] = ("global_citations",)) -> DataFrame:
    """Blank strings become NULL, en dashes become hyphens, and missing counts become 0."""
    out = {}
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            out[field.name] = F.when(F.trim(c) != "", F.translate(c, "–", "-"))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.StringType
        ):
            out[field.name] = F.transform(c, lambda x: F.translate(x, "–", "-"))
        elif field.name in zero:
            out[field.name] = F.coalesce(c, F.lit(0)).cast("bigint")
    return df.withColumns(out)
