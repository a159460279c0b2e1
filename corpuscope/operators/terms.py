"""Tables per term, per year, and per term and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.items import doc_terms, items
from ..plans.running import running
from ..plans.skew import skew_join
from .filters import exclude_terms, occurrence_bounds

def n_rows() -> Column:
    return F.count(F.lit(1)).cast("bigint")

#: Widest term axis of a matrix. Everything broadcast or densified is bounded by it.
MAX_AXIS = 3000


def check_axis(max_items: int) -> int:
    if not 0 < max_items <= MAX_AXIS:
        raise ValueError(f"max_items must be between 1 and {MAX_AXIS}")
    return max_items


def _sum(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def term_counters(df: DataFrame, col: str) -> DataFrame:
    """``(term, num_documents, global_citations)``."""
    return (
        doc_terms(df, col, ["global_citations"])
        .groupBy("term")
        .agg(n_rows().alias("num_documents"), _sum("global_citations").alias("global_citations"))
    )


def sort_columns(by: str, ascending: bool = False, tie: str = "term") -> list[Column]:
    """Order by a counter with the other as second key and the term last."""
    if by in ("term", "alphabetic"):
        return [F.col(tie).asc() if ascending else F.col(tie).desc()]
    second = {"num_documents": "global_citations", "global_citations": "num_documents"}.get(by)
    keys = [by] + ([second] if second else [])
    return [F.col(k).asc() if ascending else F.col(k).desc() for k in keys] + [F.col(tie).asc()]


def sort_terms(df: DataFrame, by: str = "num_documents", ascending: bool = False) -> DataFrame:
    """Sort a term table by documents (then citations), citations (then documents) or name."""
    return df.orderBy(*sort_columns(by, ascending))


def top_terms(
    df: DataFrame,
    by: str = "num_documents",
    k: int = 50,
    resort: str | None = None,
    ascending: bool = False,
) -> DataFrame:
    """The ``k`` first terms by one measure, shown in the order of another."""
    top = df.orderBy(*sort_columns(by)).limit(k)
    return sort_terms(top, resort or by, ascending)


def kept_terms(
    df: DataFrame,
    col: str,
    max_items: int = 50,
    top_by: str = "num_documents",
    min_occ: int = 1,
    max_occ: int | None = None,
    stop_terms: DataFrame | None = None,
) -> DataFrame:
    """The term axis of a matrix: counters of at most ``max_items`` terms."""
    counters = occurrence_bounds(term_counters(df, col), min_occ, max_occ)
    if stop_terms is not None:
        counters = exclude_terms(counters, stop_terms)
    return counters.orderBy(*sort_columns(top_by)).limit(check_axis(max_items))


def term_analysis(
    df: DataFrame,
    col: str,
    min_occ: int = 1,
    max_items: int | None = None,
    top_by: str = "num_documents",
    sort_by: str | None = None,
    ascending: bool = False,
    stop_terms: DataFrame | None = None,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Documents, global and local citations per term."""
    if years is not None:
        df = df.where(F.col("year").between(*years))
    local = ["local_citations"] if "local_citations" in df.columns else []
    table = (
        doc_terms(df, col, ["global_citations", *local])
        .groupBy("term")
        .agg(
            n_rows().alias("num_documents"),
            _sum("global_citations").alias("global_citations"),
            *[_sum(c).alias(c) for c in local],
        )
    )
    if stop_terms is not None:
        table = exclude_terms(table, stop_terms)
    table = occurrence_bounds(table, min_occ)
    if max_items is None:
        return sort_terms(table, sort_by or top_by, ascending)
    return top_terms(table, top_by, max_items, sort_by, ascending)


def country_table(
    df: DataFrame, col: str = "countries", shapes: DataFrame | None = None
) -> DataFrame:
    """Documents and citations per country, with the map name when ``shapes`` (term, shape) is given."""
    table = term_counters(df, col)
    return table if shapes is None else table.join(shapes, "term", "left")


def axis_labels(counters: DataFrame) -> DataFrame:
    """Add ``label``: the term followed by zero-padded ``documents:citations``."""

    def width(col: str) -> Column:
        return counters.agg(F.length(F.max(col).cast("string"))).scalar()

    return counters.withColumn(
        "label",
        F.concat(
            "term",
            F.lit(" "),
            F.lpad(F.col("num_documents").cast("string"), width("num_documents"), F.lit("0")),
            F.lit(":"),
            F.lpad(F.col("global_citations").cast("string"), width("global_citations"), F.lit("0")),
        ),
    )


def time_analysis(df: DataFrame) -> DataFrame:
    """Documents and citations per year without gaps, cumulated, and citations per document."""
    years = df.groupBy("year").agg(
        n_rows().alias("num_documents"), _sum("global_citations").alias("global_citations")
    ).where("year IS NOT NULL")
    calendar = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("year")
    )
    # One row per year from here on.
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = calendar.join(years, "year", "left").na.fill(0, ["num_documents", "global_citations"])
    return filled.select(
        "year",
        "num_documents",
        "global_citations",
        F.sum("num_documents").over(upto).alias("cum_num_documents"),
        F.sum("global_citations").over(upto).alias("cum_global_citations"),
        F.when(
            F.col("num_documents") > 0,
            F.round(F.col("global_citations") / F.col("num_documents"), 2),
        )
        .otherwise(0.0)
        .alias("avg_global_citations"),
    )


def terms_by_year(df: DataFrame, col: str, shares: bool = False) -> DataFrame:
    """Documents and citations per term and year.

    With ``shares`` also the percentages of the year.  Their denominators count
    rows of the exploded relation, so a document counts once per term, and once
    when it has none.
    """
    cells = (
        doc_terms(df, col, ["year", "global_citations"], outer=True)
        .groupBy("term", "year")
        .agg(n_rows().alias("num_documents"), _sum("global_citations").alias("global_citations"))
    )
    if not shares:
        return cells.where("term IS NOT NULL")
    totals = cells.groupBy("year").agg(
        F.greatest(F.sum("num_documents"), F.lit(1)).alias("_docs"),
        F.greatest(F.sum("global_citations"), F.lit(1)).alias("_cites"),
    )
    return cells.where("term IS NOT NULL").join(totals, "year").select(
        "term",
        "year",
        "num_documents",
        "global_citations",
        F.round(100.0 * F.col("num_documents") / F.col("_docs"), 2).alias("pct_documents"),
        F.round(100.0 * F.col("global_citations") / F.col("_cites"), 2).alias("pct_citations"),
    )


def terms_by_year_documents(df: DataFrame, col: str) -> DataFrame:
    """The documents behind each cell of :func:`terms_by_year`, one row per document."""
    return doc_terms(df, col, ["year"]).select("term", "year", "id")


def terms_by_year_list(
    df: DataFrame,
    col: str,
    top_by: str = "num_documents",
    top_n: int = 20,
    sort_by: str = "num_documents",
    ascending: bool = False,
) -> DataFrame:
    """The ``top_n`` term-year rows by one measure, in the order of another."""
    cells = terms_by_year(df, col)

    def order(by: str, asc: bool) -> list[Column]:
        first = [F.col(by).asc() if asc else F.col(by).desc()]
        rest = [c for c in ("num_documents", "global_citations") if c != by]
        return first + [F.col(c).desc() for c in rest] + [F.col("term"), F.col("year")]

    return cells.orderBy(*order(top_by, False)).limit(top_n).orderBy(*order(sort_by, ascending))


def terms_by_year_matrix(
    df: DataFrame,
    col: str,
    top_by: str = "num_documents",
    min_occ: int = 1,
    max_items: int = 20,
) -> DataFrame:
    """Years by terms, from the first year in which a kept term occurs."""
    top = kept_terms(df, col, max_items, top_by, min_occ)
    names = [r["term"] for r in top.select("term").collect()]
    cells = terms_by_year(df, col).where(F.col("term").isin(names))
    filled = time_analysis(df).select("year")
    first = cells.agg(F.min("year")).scalar()
    pivot = cells.groupBy("year").pivot("term", names).agg(F.sum(top_by).cast("bigint"))
    return filled.where(F.col("year") >= first).join(pivot, "year", "left").na.fill(0, names)


def terms_by_terms_by_year(
    df: DataFrame, a: str, b: str, keywords: Sequence[str] | None = None
) -> DataFrame:
    """Documents and citations per pair of terms of two columns and year."""
    pairs = df.select(
        "id", "year", "global_citations", F.explode(items(df, a)).alias("term_a"),
        items(df, b).alias("_b"),
    ).select("id", "year", "global_citations", "term_a", F.explode("_b").alias("term_b"))
    if keywords is not None:
        pairs = pairs.where(F.col("term_b").isin(list(keywords)))
    return pairs.groupBy("term_a", "term_b", "year").agg(
        n_rows().alias("num_documents"), _sum("global_citations").alias("global_citations")
    )


def impact_analysis(df: DataFrame, col: str, min_occ: int = 1) -> DataFrame:
    """Citation impact per term: totals, years active, H, G, cumulative G and M.

    ``g_index`` is the largest rank whose citations reach its square;
    ``g_index_cumulative`` uses the citations of all ranks up to it.  Documents
    are first counted per (term, citations), so ranks come from a histogram and
    no task ever sorts the documents of a term.
    """
    # Decimal shares add up the same in any order.
    share = (F.lit(1.0) / F.size(items(df, col))).cast("decimal(38,12)")
    frac = df.withColumn("_share", share)
    hist = (
        doc_terms(frac, col, ["year", "global_citations", "_share"])
        .groupBy("term", F.coalesce("global_citations", F.lit(0)).alias("c"))
        .agg(
            n_rows().alias("m"),
            F.min("year").alias("first_year"),
            F.sum("_share").alias("_share"),
        )
    )
    down = (
        Window.partitionBy("term")
        .orderBy(F.col("c").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = hist.withColumns(
        {"n1": F.sum("m").over(down), "s1": F.sum(F.col("m") * F.col("c")).over(down)}
    ).withColumns(
        {"n0": F.col("n1") - F.col("m"), "s0": F.col("s1") - F.col("m") * F.col("c")}
    )
    # Within a run of equal citations c, S(g) = s0 + c (g - n0): solve S(g) >= g * g.
    root = (
        F.col("c")
        + F.sqrt(F.col("c") * F.col("c") + 4.0 * (F.col("s0") - F.col("c") * F.col("n0")))
    ) / 2
    g_run = F.least(F.col("n1"), F.floor(root + 1e-9))
    last_year = df.agg(F.max("year")).scalar()
    table = ranked.groupBy("term").agg(
        F.sum("m").cast("bigint").alias("num_documents"),
        F.sum("_share").alias("_frac"),
        F.sum(F.col("m") * F.col("c")).cast("bigint").alias("global_citations"),
        F.min("first_year").alias("first_year"),
        F.max(F.least("c", "n1")).cast("bigint").alias("h_index"),
        F.max(F.least(F.floor(F.sqrt("c")), F.col("n1"))).cast("bigint").alias("g_index"),
        F.coalesce(F.max(F.when(g_run > F.col("n0"), g_run)), F.lit(0))
        .cast("bigint")
        .alias("g_index_cumulative"),
    )
    years = last_year - F.col("first_year") + 1
    return occurrence_bounds(table, min_occ).select(
        "term",
        "num_documents",
        F.round("_frac", 2).cast("double").alias("frac_num_documents"),
        "global_citations",
        "first_year",
        years.cast("bigint").alias("years"),
        F.round(F.col("global_citations") / years, 2).alias("citations_per_year"),
        F.round(F.col("global_citations") / F.col("num_documents"), 2).alias(
            "citations_per_document"
        ),
        "h_index",
        "g_index",
        "g_index_cumulative",
        F.round(F.col("h_index") / years, 2).alias("m_index"),
    )


def collaboration_analysis(df: DataFrame, col: str, min_occ: int = 1) -> DataFrame:
    """Single- and multi-item documents per term, and their ratio."""
    sized = df.select("*", F.size(items(df, col)).alias("_size"))
    table = (
        doc_terms(sized, col, ["_size"])
        .groupBy("term")
        .agg(
            n_rows().alias("num_documents"),
            F.count_if(F.col("_size") == 1).alias("single"),
            F.count_if(F.col("_size") > 1).alias("multi"),
        )
    )
    return occurrence_bounds(table, min_occ).select(
        "term",
        "num_documents",
        "single",
        "multi",
        F.round(F.col("multi") / F.greatest("single", F.lit(1)), 2).alias("ratio"),
    )


def count_terms(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    """Number of distinct terms of a column; ``approximate`` uses a sketch."""
    term = doc_terms(df, col)
    count = F.approx_count_distinct("term") if approximate else F.count_distinct("term")
    return term.agg(count.cast("bigint").alias("num_terms"))


def distinct_terms(df: DataFrame, col: str) -> DataFrame:
    return doc_terms(df, col).select("term").distinct().orderBy("term")


def keywords_coverage(df: DataFrame, col: str, ranked: DataFrame) -> DataFrame:
    """Documents covered as the terms of ``ranked`` (term, rank) are added in rank order.

    A document counts at its best rank, so the corpus is read once.
    """
    best = (
        skew_join(doc_terms(df, col), ranked, "term")
        .groupBy("id")
        .agg(F.min("rank").alias("rank"))
    )
    added = best.groupBy("rank").agg(n_rows().alias("_added"))
    total = df.where(items(df, col).isNotNull()).agg(F.count(F.lit(1))).scalar()
    placed = ranked.join(added, "rank", "left").withColumn("_all", F.lit(0))
    sums = {"cum_documents": F.coalesce("_added", F.lit(0)).cast("bigint")}
    return (
        running(placed, ["_all"], [F.col("rank"), F.col("term")], sums)
        .select("term", "rank", "cum_documents")
        .withColumn("cum_pct", F.round(100.0 * F.col("cum_documents") / total, 1))
    )


def top_documents(
    df: DataFrame, n: int = 50, scope: str = "global", normalized: bool = False
) -> DataFrame:
    """The ``n`` most cited documents, optionally per year of age."""
    metric = F.coalesce(F.col(f"{scope}_citations"), F.lit(0))
    if normalized:
        age = df.agg(F.max("year")).scalar() - F.col("year") + 1
        metric = F.round(metric / age, 3)
    return df.withColumn("metric", metric).orderBy(F.col("metric").desc(), "id").limit(n)


def activity_span(df: DataFrame, col: str) -> DataFrame:
    """First and last active year per term, the width of the span and its offset."""
    origin = df.agg(F.min("year")).scalar()
    return (
        doc_terms(df, col, ["year"])
        .groupBy("term")
        .agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
        .select(
            "term",
            "first_year",
            "last_year",
            (F.col("last_year") - F.col("first_year") + 1).cast("bigint").alias("width"),
            (F.col("first_year") - origin).cast("bigint").alias("offset"),
        )
    )


def active_flags(df: DataFrame, term: str = "term", year: str = "year") -> DataFrame:
    """Mark the first and last active year of each term of a term-year table."""
    span = df.groupBy(term).agg(F.min(year).alias("_first"), F.max(year).alias("_last"))
    return skew_join(df, span, term).select(
        *df.columns,
        (F.col(year) == F.col("_first")).alias("is_first"),
        (F.col(year) == F.col("_last")).alias("is_last"),
    )


def growth_indicators(df: DataFrame, col: str, w: int = 2, how: str = "outer") -> DataFrame:
    """Growth per term over the last ``w`` observed years.

    ``average_growth_rate`` compares the last year with the one ``w`` years
    before, ``average_docs_per_year`` and ``pct_docs_last_years`` describe the
    window, ``before`` and ``between`` count documents outside and inside it.
    ``how='inner'`` keeps only terms for which every indicator is defined.
    """
    counts = terms_by_year(df, col)
    years = counts.select("year").distinct()
    # One row per observed year.
    ordered = years.withColumn("_r", F.row_number().over(Window.orderBy(F.col("year").desc())))
    bounds = ordered.agg(
        F.max("year").alias("last_year"),
        F.min(F.when(F.col("_r") <= w, F.col("year"))).alias("first_year"),
        F.min(F.when(F.col("_r") <= w + 1, F.col("year"))).alias("base_year"),
    )
    last, first, base = (
        bounds.select(c).scalar() for c in ("last_year", "first_year", "base_year")
    )
    n = F.col("num_documents")

    def docs(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    total = df.agg(F.count(F.lit(1))).scalar()
    table = counts.groupBy("term").agg(
        docs(F.col("year") == last).alias("_last"),
        docs(F.col("year") == base).alias("_base"),
        docs(F.col("year") < first).alias("before"),
        docs(F.col("year") >= first).alias("between"),
    )
    if how == "inner":
        table = table.where("(_last > 0 OR _base > 0) AND between > 0 AND before > 0")
    ady = F.col("between") / F.lit(float(w))
    return table.select(
        "term",
        ((F.col("_last") - F.col("_base")) / F.lit(float(w))).alias("average_growth_rate"),
        ady.alias("average_docs_per_year"),
        F.round(100.0 * ady / total, 2).alias("pct_docs_last_years"),
        "before",
        "between",
        F.lit(first).cast("int").alias("window_start"),
        F.lit(last).cast("int").alias("window_end"),
    )
