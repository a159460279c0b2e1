"""Corpus summaries: descriptive statistics, coverage, document types."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import items
from .terms import n_rows


#: Multi-valued and scalar columns whose distinct values are counted when present.
COUNTED = [
    ("authors", "authors"),
    ("institutions", "authors"),
    ("institution_1st_author", "authors"),
    ("countries", "authors"),
    ("country_1st_author", "authors"),
    ("author_keywords", "keywords"),
    ("author_keywords_cleaned", "keywords"),
    ("index_keywords", "keywords"),
    ("index_keywords_cleaned", "keywords"),
    ("keywords", "keywords"),
    ("keywords_cleaned", "keywords"),
    ("abstract_keywords", "keywords"),
    ("global_references", "general"),
    ("source_title", "general"),
]


def document_types(df: DataFrame) -> DataFrame:
    return df.groupBy("document_type").agg(n_rows().alias("num_documents"))


def coverage(df: DataFrame) -> DataFrame:
    """Non-null values per column, and their percentage."""
    counts = df.agg(n_rows().alias("_all"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    return (
        counts.unpivot("_all", df.columns, "column", "num_values")
        .select("column", "num_values", F.round(100.0 * F.col("num_values") / F.col("_all"), 2).alias("pct"))
    )


def descriptive_statistics(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Corpus metrics as ``(category, metric, value)``.

    All distinct counts come from one pass: the items of every counted column
    are stacked as (column, term) pairs and aggregated together.
    """
    counted = [(c, g) for c, g in COUNTED if c in df.columns]
    counted += [(c, "other") for c in (extra or [])]
    empty = F.array().cast("array<struct<c:string,t:string>>")

    def tagged(name: str, cells):
        return F.coalesce(
            F.transform(cells, lambda x: F.struct(F.lit(name).alias("c"), x.alias("t"))), empty
        )

    stacks = [tagged(c, items(df, c)) for c, _ in counted]
    size = F.lit(0)
    if "authors" in df.columns:
        size = F.coalesce(F.size(items(df, "authors")), F.lit(0))
        stacks.append(tagged("_co_authors", F.when(size > 1, items(df, "authors"))))
    pairs = df.select(F.explode(F.concat(*stacks)).alias("p")).select("p.c", "p.t")
    distinct = (
        pairs.groupBy("c", "t").agg(n_rows().alias("n")).groupBy("c").agg(
            n_rows().alias("distinct"), F.sum("n").alias("rows")
        )
    )
    wide = distinct.agg(
        *[
            F.coalesce(F.max(F.when(F.col("c") == c, F.col("distinct"))), F.lit(0)).alias(f"d_{c}")
            for c in [*[c for c, _ in counted], "_co_authors"]
        ],
        *[
            F.coalesce(F.max(F.when(F.col("c") == c, F.col("rows"))), F.lit(0)).alias(f"r_{c}")
            for c, _ in counted
        ],
    )
    years = df.groupBy("year").agg(
        n_rows().alias("docs"),
        F.sum(F.coalesce("global_citations", F.lit(0))).alias("cites"),
        F.count_if(size == 1).alias("single"),
        F.count_if(size > 1).alias("multi"),
        F.sum(size).alias("appearances"),
    )
    base = years.agg(
        F.sum("docs").alias("docs"),
        F.min("year").alias("first"),
        F.max("year").alias("last"),
        F.min_by("docs", "year").alias("docs_first"),
        F.sum("cites").alias("cites"),
        F.sum("single").alias("single"),
        F.sum("multi").alias("multi"),
        F.sum("appearances").alias("appearances"),
    )
    one = base.withColumns({c: wide.select(c).scalar() for c in wide.columns})
    docs = F.col("docs")
    span = F.col("last") - F.col("first") + 1

    def ratio(a, b):
        return F.round(F.try_divide(a.cast("double"), b), 2)

    metrics = [
        ("general", "documents", docs),
        ("general", "first_year", F.col("first")),
        ("general", "last_year", F.col("last")),
        (
            "general",
            "compound_annual_growth_rate",
            F.round(100.0 * (F.pow(docs / F.col("docs_first"), F.lit(1.0) / span) - 1), 2),
        ),
        ("general", "citations_per_document", ratio(F.col("cites"), docs)),
        ("general", "citations_per_document_per_year", ratio(F.col("cites"), docs * span)),
    ]
    if any(c == "source_title" for c, _ in counted):
        metrics.append(("general", "documents_per_source", ratio(docs, F.col("d_source_title"))))
    if any(c == "global_references" for c, _ in counted):
        metrics.append(
            ("general", "references_per_document", ratio(F.col("r_global_references"), docs))
        )
    if "authors" in df.columns:
        authors = F.col("d_authors")
        metrics += [
            ("authors", "author_appearances", F.col("appearances")),
            ("authors", "documents_per_author", ratio(docs, authors)),
            ("authors", "authors_per_document", ratio(authors, docs)),
            ("authors", "single_authored_documents", F.col("single")),
            ("authors", "multi_authored_documents", F.col("multi")),
            ("authors", "co_authors_per_document", ratio(F.col("appearances"), docs)),
            ("authors", "collaboration_index", ratio(F.col("d__co_authors"), F.col("multi"))),
        ]
    metrics += [(g, f"distinct_{c}", F.col(f"d_{c}")) for c, g in counted]
    rows = F.array(
        *[
            F.struct(
                F.lit(g).alias("category"), F.lit(m).alias("metric"), v.cast("double").alias("value")
            )
            for g, m, v in metrics
        ]
    )
    table = one.select(F.inline(rows))
    if "document_type" in df.columns:
        types = document_types(df).select(
            F.lit("document types").alias("category"),
            F.col("document_type").alias("metric"),
            F.col("num_documents").cast("double").alias("value"),
        )
        table = table.unionByName(types)
    return table


