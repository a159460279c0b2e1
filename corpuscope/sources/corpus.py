"""Corpus files: bibliographic exports, JSON records and the cleaned corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Export headings and the corpus columns they become.
SCOPUS_TAGS = {
    "Abbreviated Source Title": "abb_source_title",
    "Abstract": "abstract",
    "Affiliations": "affiliations",
    "Author Keywords": "author_keywords",
    "Author(s) ID": "authors_id",
    "Authors": "authors",
    "Cited by": "global_citations",
    "Document Type": "document_type",
    "DOI": "doi",
    "Index Keywords": "index_keywords",
    "References": "global_references",
    "Source title": "source_title",
    "Title": "title",
    "Year": "year",
}
DIMENSIONS_TAGS = {
    "Abstract": "abstract",
    "Authors (Raw Affiliation)": "affiliations",
    "Authors": "authors",
    "DOI": "doi",
    "PubYear": "year",
    "Source title": "source_title",
    "Times cited": "global_citations",
    "Title": "title",
}
WOS_TAGS = {
    "AB": "abstract",
    "AU": "authors",
    "C1": "affiliations",
    "CR": "global_references",
    "DE": "author_keywords",
    "DI": "doi",
    "DT": "document_type",
    "ID": "index_keywords",
    "JI": "abb_source_title",
    "PY": "year",
    "RI": "authors_id",
    "SO": "source_title",
    "TI": "title",
    "Z9": "global_citations",
}

LIST_COLUMNS = [
    "authors",
    "authors_id",
    "affiliations",
    "countries",
    "institutions",
    "author_keywords",
    "index_keywords",
    "global_references",
    "local_references",
]

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("source_title", T.StringType()),
        T.StructField("abb_source_title", T.StringType()),
        T.StructField("document_type", T.StringType()),
        *[T.StructField(c, T.ArrayType(T.StringType())) for c in LIST_COLUMNS],
        T.StructField("global_citations", T.LongType()),
        T.StructField("local_citations", T.LongType()),
        T.StructField("num_authors", T.IntegerType()),
        T.StructField("frac_num_documents", T.DoubleType()),
        T.StructField("historiograph_id", T.StringType()),
        T.StructField("bradford_law_zone", T.IntegerType()),
    ]
)


def apply_tag_map(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns that are present, under their corpus names."""
    present = [c for c in df.columns if c in tags]
    extra = [c for c in df.columns if c == "id" and c not in tags]
    return df.select(*extra, *[F.col(f"`{c}`").alias(tags[c]) for c in present])


def to_corpus_types(df: DataFrame, sep: str = ";") -> DataFrame:
    """Cast known columns to the corpus types; ``sep``-separated strings become arrays."""
    out = {}
    for field in CORPUS_SCHEMA.fields:
        if field.name not in df.columns:
            continue
        if isinstance(field.dataType, T.ArrayType) and not isinstance(
            df.schema[field.name].dataType, T.ArrayType
        ):
            parts = F.filter(
                F.transform(F.split(field.name, f"\\Q{sep}\\E", -1), lambda x: F.trim(x)), lambda x: x != ""
            )
            out[field.name] = F.when(F.size(parts) > 0, parts)
        elif isinstance(df.schema[field.name].dataType, T.StringType) and isinstance(
            field.dataType, (T.LongType, T.IntegerType, T.DoubleType)
        ):
            out[field.name] = F.expr(f"try_cast(`{field.name}` AS DOUBLE)").cast(field.dataType)
        else:
            out[field.name] = F.col(field.name).cast(field.dataType)
    return df.withColumns(out)


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    tags: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read a corpus.

    ``csv`` reads an export with quoted multi-line fields and renames it by
    ``tags`` (default: the Scopus headings); ``columns`` gives the headings of
    the file, in order, so that nothing has to be inferred.  ``json`` reads one
    record per line with the corpus schema, and ``parquet`` a written corpus.
    """
    if fmt == "csv":
        reader = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
        )
        if columns is not None:
            reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        return to_corpus_types(apply_tag_map(reader.csv(path), tags or SCOPUS_TAGS))
    if fmt == "json":
        return spark.read.schema(CORPUS_SCHEMA).json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown corpus format {fmt!r}")


def write_corpus(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("year",)
) -> None:
    """Write a corpus as parquet partitioned by year, or as JSON records."""
    if fmt == "parquet":
        df.write.partitionBy(*partition_by).parquet(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown corpus format {fmt!r}")


def concat_corpora(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack corpora by column name; a column missing from one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
