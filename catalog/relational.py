"""Queries on term tables, laws, filters, windows, sorts, sets and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions import items as I
from corpuscope.operators import filters as FI
from corpuscope.operators import laws as L
from corpuscope.operators import sets as ST
from corpuscope.operators import summary as S
from corpuscope.operators import terms as T
from corpuscope.operators import windows as W

from .views import citation_edges, corpus, table, with_views

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- projections

@query("doc_terms", with_views("docs", "au") + """
SELECT docs.id, au.term, docs.year FROM docs LEFT JOIN au USING (id)""")
def _(spark, sf):
    return I.doc_terms(corpus(spark, sf, "authors"), "authors", ["year"], outer=True).select(
        "id", "term", "year")


@query("doc_terms_from_text", with_views("docs", "kw") + """
SELECT kw.id, kw.term FROM kw""")
def _(spark, sf):
    c = corpus(spark, sf, "author_keywords")
    text = c.withColumn("author_keywords", F.concat(
        F.array_join("author_keywords", " ; "), F.lit(";"), F.element_at("author_keywords", 1)))
    return I.doc_terms(text, "author_keywords")


@query("map_items", with_views("docs", "kw") + """
SELECT docs.id, string_agg(upper(term), ';' ORDER BY upper(term)) AS author_keywords
FROM docs LEFT JOIN kw ON kw.id = docs.id AND term <> 'Brand#1' GROUP BY docs.id""")
def _(spark, sf):
    c = I.map_items(corpus(spark, sf, "author_keywords"), "author_keywords",
                    lambda x: F.when(x != "Brand#1", F.upper(x)))
    return c.select("id", F.array_join(F.array_sort("author_keywords"), ";").alias("author_keywords"))


@query("rename_column", "SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders")
def _(spark, sf):
    return I.rename_column(corpus(spark, sf, "document_type"), "document_type", "kind").select("id", "kind")


@query("copy_column", "SELECT o_orderkey AS id, o_orderpriority AS document_type, o_orderpriority AS kind FROM orders")
def _(spark, sf):
    return I.copy_column(corpus(spark, sf, "document_type"), "document_type", "kind").select(
        "id", "document_type", "kind")


@query("drop_columns", with_views("docs") + " SELECT id, year FROM docs")
def _(spark, sf):
    return I.drop_columns(corpus(spark, sf, "document_type"), ["document_type", "global_citations"])


@query("merge_columns", with_views("docs", "kw", "ik") + """
SELECT docs.id, string_agg(u.term, ';' ORDER BY u.term) AS keywords
FROM docs LEFT JOIN (SELECT * FROM kw UNION SELECT * FROM ik) u USING (id) GROUP BY docs.id""")
def _(spark, sf):
    c = I.merge_columns(corpus(spark, sf, "author_keywords", "index_keywords"),
                        ["author_keywords", "index_keywords"], "keywords")
    return c.select("id", F.array_join("keywords", ";").alias("keywords"))


@query("author_counts", with_views("docs", "au") + """
SELECT docs.id, CAST(count(term) AS INTEGER) AS num_authors,
       CASE WHEN count(term) = 0 THEN 0.0 ELSE round(1.0 / count(term), 6) END::DOUBLE AS frac_num_documents
FROM docs LEFT JOIN au USING (id) GROUP BY docs.id""")
def _(spark, sf):
    return I.author_counts(corpus(spark, sf, "authors")).select(
        "id", "num_authors", F.round("frac_num_documents", 6).alias("frac_num_documents"))


@query("first_author_country", with_views("docs") + """, l AS (
SELECT l_orderkey AS id, n_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, s_name) AS r
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT docs.id, n_name AS country_1st_author FROM docs LEFT JOIN l ON docs.id = l.id AND r = 1""")
def _(spark, sf):
    c = corpus(spark, sf, "countries")
    return c.select("id", I.first_item(c, "countries").alias("country_1st_author"))


@query("distinct_countries", with_views("docs", "co") + """
SELECT docs.id, CAST(count(term) AS INTEGER) AS num_countries, string_agg(term, ';' ORDER BY term) AS countries
FROM docs LEFT JOIN co USING (id) GROUP BY docs.id""")
def _(spark, sf):
    c = corpus(spark, sf, "countries")
    doubled = c.withColumn("countries", F.concat("countries", F.reverse("countries")))
    out = I.reduce_list(doubled, "countries")
    return out.select("id", F.coalesce(F.size("countries"), F.lit(0)).alias("num_countries"),
                      F.array_join(F.array_sort("countries"), ";").alias("countries"))


@query("historiograph_id", with_views("docs") + """
SELECT id, year || '-' || (row_number() OVER (PARTITION BY year ORDER BY id) - 1) AS historiograph_id FROM docs""")
def _(spark, sf):
    return W.historiograph_id(corpus(spark, sf)).select("id", "historiograph_id")


@query("normalise_blanks", with_views("docs") + """
SELECT id, CASE WHEN dtype LIKE '1%' THEN NULL ELSE replace(dtype, '–', '-') END AS document_type,
       CASE WHEN cites = 0 THEN 0 ELSE cites END AS global_citations FROM docs""")
def _(spark, sf):
    c = corpus(spark, sf, "document_type")
    dirty = c.withColumn("document_type", F.when(F.col("document_type").startswith("1"), " ").otherwise(
        F.translate("document_type", "-", "–"))).withColumn(
        "global_citations", F.when(F.col("global_citations") > 0, F.col("global_citations")))
    return I.normalise_blanks(dirty).select("id", "document_type", "global_citations")


# -------------------------------------------------------------------- filters

@query("filter_records", with_views("docs") + """, p AS (SELECT source, count(*) AS n FROM docs GROUP BY 1),
g AS (SELECT n, sum(sum(n)) OVER (ORDER BY n DESC) AS cum FROM p GROUP BY n),
z AS (SELECT source, CASE WHEN cum > 2 * ((SELECT count(*) FROM docs) // 3) THEN 3
      WHEN cum > (SELECT count(*) FROM docs) // 3 THEN 2 ELSE 1 END AS zone FROM p JOIN g USING (n))
SELECT id, year, cites AS global_citations, dtype AS document_type, zone AS bradford_law_zone
FROM docs JOIN z USING (source)
WHERE year BETWEEN 1996 AND 1999 AND cites BETWEEN 10 AND 80 AND zone <= 2 AND dtype IN ('1-URGENT', '2-HIGH')""")
def _(spark, sf):
    zoned = L.bradford_zones(corpus(spark, sf, "source_title", "document_type"))
    bounds = FI.RecordFilter((1996, 1999), (10, 80), 2, ["1-URGENT", "2-HIGH"])
    return FI.filter_records(zoned, bounds).select(
        "id", "year", "global_citations", "document_type", "bradford_law_zone")


@query("filter_records_by_cluster", with_views("docs", "kw") + """
SELECT DISTINCT docs.id FROM docs JOIN kw USING (id)
WHERE CAST(substr(term, 7) AS INTEGER) % 5 = 2 AND year >= 1998""")
def _(spark, sf):
    c = corpus(spark, sf, "author_keywords")
    clusters = I.doc_terms(c, "author_keywords").select(
        F.concat(F.lit("CL_"), F.substring("term", 7, 9).cast("int") % 5).alias("cluster"), "id").distinct()
    return FI.filter_records(c, FI.RecordFilter(years=(1998, 9999), cluster="CL_2"), clusters).select("id")


@query("filter_bounds", with_views("docs") + """
SELECT min(year) AS min_year, max(year) AS max_year, min(cites) AS min_citations, max(cites) AS max_citations,
       string_agg(DISTINCT dtype, ';' ORDER BY dtype) AS document_types FROM docs""")
def _(spark, sf):
    return FI.filter_bounds(corpus(spark, sf, "document_type")).withColumn(
        "document_types", F.array_join("document_types", ";"))


@query("years_range", with_views("docs") + " SELECT id, year FROM docs WHERE year BETWEEN 1997 AND 1999")
def _(spark, sf):
    return FI.years_range(corpus(spark, sf), 1997, 1999).select("id", "year")


@query("exclude_terms", with_views("kw") + ", s AS (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE 'Brand#1%')"
       " SELECT id, term FROM kw WHERE term NOT IN (SELECT p_brand FROM s)")
def _(spark, sf):
    stops = table(spark, sf, "part").where("p_brand LIKE 'Brand#1%'").select(F.col("p_brand").alias("term"))
    return FI.exclude_terms(I.doc_terms(corpus(spark, sf, "author_keywords"), "author_keywords"), stops)


@query("limit_terms", with_views("docs", "kw") + """
SELECT id, term, year FROM kw JOIN docs USING (id) WHERE term IN ('Brand#3', 'Brand#4', 'Brand#5')
AND year NOT IN (1999)""")
def _(spark, sf):
    dt = I.doc_terms(corpus(spark, sf, "author_keywords"), "author_keywords", ["year"])
    return FI.limit_terms(dt, {"term": ["Brand#3", "Brand#4", "Brand#5"]}, {"year": [1999]}).select(
        "id", "term", "year")


@query("corpus_filter", with_views("kw") + """
SELECT DISTINCT id FROM kw WHERE CAST(substr(term, 7) AS INTEGER) % 12 = 1""")
def _(spark, sf):
    clusters = table(spark, sf, "part").select(
        (F.substring("p_brand", 7, 9).cast("int") % 12).cast("string").alias("cluster"),
        F.col("p_brand").alias("term")).distinct()
    return FI.corpus_filter(corpus(spark, sf, "author_keywords"), "author_keywords", clusters, "1").select("id")


@query("occurrence_bounds", with_views("src") + """
SELECT term, count(*) AS num_documents FROM src GROUP BY term HAVING count(*) >= 8 AND count(*) < 12""")
def _(spark, sf):
    counters = T.term_counters(corpus(spark, sf, "source_title"), "source_title")
    return FI.occurrence_bounds(counters, 8, 12).select("term", "num_documents")


@query("min_terms_per_doc", with_views("au") + """
SELECT id, term FROM au WHERE id IN (SELECT id FROM au GROUP BY id HAVING count(*) >= 6)""")
def _(spark, sf):
    return FI.min_terms_per_doc(I.doc_terms(corpus(spark, sf, "authors"), "authors"), 6)


@query("select_types", with_views("docs") + " SELECT id, dtype AS document_type FROM docs WHERE dtype IN ('5-LOW', '2-HIGH')")
def _(spark, sf):
    return FI.select_types(corpus(spark, sf, "document_type"), ["5-LOW", "2-HIGH"]).select("id", "document_type")


@query("documents_for_term", with_views("docs", "au") + """
SELECT id, 'Order number ' || id || ' of the year ' || year AS title, cites AS global_citations
FROM docs JOIN au USING (id) WHERE term = 'Supplier#000000007'""")
def _(spark, sf):
    return FI.documents_for_term(corpus(spark, sf, "authors", "title"), "authors", "Supplier#000000007").select(
        "id", "title", "global_citations")


@query("co_present_values", with_views("au", "kw") + """
SELECT DISTINCT kw.term FROM au JOIN kw USING (id) WHERE au.term = 'Supplier#000000003'""")
def _(spark, sf):
    return FI.co_present_values(corpus(spark, sf, "authors", "author_keywords"),
                                "authors", "Supplier#000000003", "author_keywords")


@query("documents_for_pair", with_views("docs", "au", "kw") + """
SELECT id, cites AS global_citations FROM docs JOIN au USING (id) JOIN kw USING (id)
WHERE au.term = 'Supplier#000000003' AND kw.term = 'Brand#7'""")
def _(spark, sf):
    return FI.documents_for_pair(corpus(spark, sf, "authors", "author_keywords", "title"),
                                 "authors", "Supplier#000000003", "author_keywords", "Brand#7").select(
        "id", "global_citations")


# --------------------------------------------------------------- term tables

_LOCAL = ", lc AS (SELECT cited AS id, count(*) AS local FROM edges GROUP BY 1)"


def with_local_citations(spark, sf, *cols):
    cited = citation_edges(spark, sf).groupBy(F.col("cited").alias("id")).agg(
        F.count(F.lit(1)).alias("local_citations"))
    return corpus(spark, sf, *cols).join(cited, "id", "left").na.fill(0, ["local_citations"])


@query("term_analysis", with_views("docs", "au", "placed", "edges") + _LOCAL + """
SELECT term, count(*) AS num_documents, CAST(sum(cites) AS BIGINT) AS global_citations,
       CAST(sum(coalesce(local, 0)) AS BIGINT) AS local_citations
FROM docs JOIN au USING (id) LEFT JOIN lc USING (id) WHERE year BETWEEN 1996 AND 2000
GROUP BY term HAVING count(*) >= 20 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 40""")
def term_analysis(spark, sf):
    return T.term_analysis(with_local_citations(spark, sf, "authors"), "authors", min_occ=20, max_items=40,
                           sort_by="global_citations", years=(1996, 2000))


@query("term_analysis_by_citations", with_views("docs", "kw") + """
SELECT term, count(*) AS num_documents, CAST(sum(cites) AS BIGINT) AS global_citations
FROM docs JOIN kw USING (id) WHERE term NOT LIKE 'Brand#2%' GROUP BY term ORDER BY 3 DESC, 2 DESC, 1 LIMIT 8""")
def _(spark, sf):
    stops = table(spark, sf, "part").where("p_brand LIKE 'Brand#2%'").select(F.col("p_brand").alias("term"))
    return T.term_analysis(corpus(spark, sf, "author_keywords"), "author_keywords", max_items=8,
                           top_by="global_citations", stop_terms=stops)


@query("axis_labels", with_views("docs", "src") + """, t AS (
SELECT term, count(*) AS n, CAST(sum(cites) AS BIGINT) AS c FROM docs JOIN src USING (id) GROUP BY term)
SELECT term, term || ' ' || lpad(n::VARCHAR, (SELECT length(max(n)::VARCHAR) FROM t)::INTEGER, '0') || ':' ||
       lpad(c::VARCHAR, (SELECT length(max(c)::VARCHAR) FROM t)::INTEGER, '0') AS label FROM t""")
def _(spark, sf):
    return T.axis_labels(T.term_counters(corpus(spark, sf, "source_title"), "source_title")).select("term", "label")


@query("time_analysis", with_views("docs") + """, y AS (
SELECT CASE WHEN year >= 1998 THEN year + 1 ELSE year END AS year, count(*) AS n, CAST(sum(cites) AS BIGINT) AS c FROM docs GROUP BY 1),
f AS (SELECT CAST(g.year AS INTEGER) AS year, coalesce(n, 0) AS n, coalesce(c, 0) AS c
      FROM (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) FROM y) + 1)) AS year) g LEFT JOIN y USING (year))
SELECT year, n AS num_documents, c AS global_citations,
       CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS cum_num_documents,
       CAST(sum(c) OVER (ORDER BY year) AS BIGINT) AS cum_global_citations,
       CAST(CASE WHEN n > 0 THEN round(c::DOUBLE / n, 2) ELSE 0 END AS DOUBLE) AS avg_global_citations FROM f""")
def _(spark, sf):
    # Later years move on by one, which leaves a year without documents.
    later = F.when(F.col("year") >= 1998, F.col("year") + 1).otherwise(F.col("year"))
    return T.time_analysis(corpus(spark, sf).withColumn("year", later))


@query("terms_by_year", with_views("docs", "au") + """
SELECT term, year, count(*) AS num_documents, CAST(sum(cites) AS BIGINT) AS global_citations
FROM docs JOIN au USING (id) GROUP BY ALL""")
def _(spark, sf):
    return T.terms_by_year(corpus(spark, sf, "authors"), "authors")


@query("terms_by_year_documents", with_views("docs", "au") + " SELECT term, year, id FROM docs JOIN au USING (id)")
def _(spark, sf):
    return T.terms_by_year_documents(corpus(spark, sf, "authors"), "authors")


@query("terms_by_year_shares", with_views("docs", "kw") + """, c AS (
SELECT term, year, count(*) AS n, CAST(sum(cites) AS BIGINT) AS c FROM docs LEFT JOIN kw USING (id) GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY year) AS tn, sum(c) OVER (PARTITION BY year) AS tc FROM c)
SELECT term, year, n AS num_documents, c AS global_citations,
       round(100.0::DOUBLE * n / greatest(tn, 1), 2) AS pct_documents, round(100.0::DOUBLE * c / greatest(tc, 1), 2) AS pct_citations
FROM s WHERE term IS NOT NULL""")
def _(spark, sf):
    return T.terms_by_year(corpus(spark, sf, "author_keywords"), "author_keywords", shares=True)


@query("terms_by_year_list", with_views("docs", "au") + """
SELECT term, year, count(*) AS num_documents, CAST(sum(cites) AS BIGINT) AS global_citations
FROM docs JOIN au USING (id) GROUP BY ALL ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 25""")
def _(spark, sf):
    return T.terms_by_year_list(corpus(spark, sf, "authors"), "authors", "global_citations", 25, "year", True)


@query("terms_by_year_matrix", with_views("docs", "au") + """, top AS (
SELECT term, row_number() OVER (ORDER BY count(*) DESC, sum(cites) DESC, term) AS r FROM docs JOIN au USING (id) GROUP BY term),
c AS (SELECT r, year, count(*) AS n FROM docs JOIN au USING (id) JOIN top USING (term) WHERE r <= 4 GROUP BY ALL)
SELECT year, """ + ", ".join(f"coalesce(max(CASE WHEN r = {i} THEN n END), 0) AS top_{i}" for i in range(1, 5)) + """
FROM c GROUP BY year""")
def _(spark, sf):
    m = T.terms_by_year_matrix(corpus(spark, sf, "authors"), "authors", max_items=4)
    return m.toDF("year", *[f"top_{i}" for i in range(1, len(m.columns))])


@query("terms_by_terms_by_year", with_views("docs", "au", "kw") + """
SELECT au.term AS term_a, kw.term AS term_b, year, count(*) AS num_documents, CAST(sum(cites) AS BIGINT) AS global_citations
FROM docs JOIN au USING (id) JOIN kw USING (id) WHERE kw.term IN ('Brand#1', 'Brand#2', 'Brand#9') GROUP BY ALL""")
def _(spark, sf):
    return T.terms_by_terms_by_year(corpus(spark, sf, "authors", "author_keywords"), "authors", "author_keywords",
                                    ["Brand#1", "Brand#2", "Brand#9"])


def _growth_sql(inner):
    return with_views("docs", "kw") + """, c AS (SELECT term, year, count(*) AS n FROM docs JOIN kw USING (id) GROUP BY ALL),
y AS (SELECT DISTINCT year, dense_rank() OVER (ORDER BY year DESC) AS r FROM c),
b AS (SELECT max(year) AS l, min(CASE WHEN r <= 3 THEN year END) AS f, min(CASE WHEN r <= 4 THEN year END) AS a FROM y),
t AS (SELECT term, sum(CASE WHEN year = l THEN n ELSE 0 END) AS nl, sum(CASE WHEN year = a THEN n ELSE 0 END) AS na,
      sum(CASE WHEN year < f THEN n ELSE 0 END) AS nb, sum(CASE WHEN year >= f THEN n ELSE 0 END) AS nw,
      any_value(f) AS f, any_value(l) AS l FROM c, b GROUP BY term)
SELECT term, round((nl - na) / 3.0, 6)::DOUBLE AS average_growth_rate, round(nw / 3.0, 6)::DOUBLE AS average_docs_per_year,
       round(100.0::DOUBLE * (nw / 3.0::DOUBLE) / (SELECT count(*) FROM docs), 2) AS pct_docs_last_years,
       CAST(nb AS BIGINT) AS "before", CAST(nw AS BIGINT) AS "between", f AS window_start, l AS window_end FROM t""" + (
        " WHERE (nl > 0 OR na > 0) AND nw > 0 AND nb > 0" if inner else "")


def _rounded_growth(df):
    return df.withColumns({c: F.round(c, 6) for c in ("average_growth_rate", "average_docs_per_year")})


@query("growth_indicators", _growth_sql(False))
def _(spark, sf):
    return _rounded_growth(T.growth_indicators(corpus(spark, sf, "author_keywords"), "author_keywords", 3))


@query("growth_indicators_inner", _growth_sql(True).replace("JOIN kw USING (id) GROUP", "JOIN src AS kw USING (id) GROUP").replace("WITH docs", "WITH src AS (SELECT o_orderkey AS id, c_name AS term FROM orders JOIN customer ON o_custkey = c_custkey), docs"))
def _(spark, sf):
    return _rounded_growth(T.growth_indicators(corpus(spark, sf, "source_title"), "source_title", 3, how="inner"))


_IMPACT = """, r AS (SELECT term, year, cites, row_number() OVER (PARTITION BY term ORDER BY cites DESC, id) AS rn,
  sum(cites) OVER (PARTITION BY term ORDER BY cites DESC, id ROWS UNBOUNDED PRECEDING) AS run, {frac} AS frac FROM docs JOIN {rel} USING (id) {extra}),
t AS (SELECT term, count(*) AS n, sum(cites) AS c, sum(frac) AS fr, min(year) AS fy, (SELECT max(year) FROM docs) - min(year) + 1 AS y,
  coalesce(max(CASE WHEN cites >= rn THEN rn END), 0) AS h, coalesce(max(CASE WHEN cites >= rn * rn THEN rn END), 0) AS g,
  coalesce(max(CASE WHEN run >= rn * rn THEN rn END), 0) AS gc FROM r GROUP BY term HAVING count(*) >= {m})
SELECT term, n AS num_documents, CAST(round(fr, 2) AS DOUBLE) AS frac_num_documents, CAST(c AS BIGINT) AS global_citations, fy AS first_year,
  CAST(y AS BIGINT) AS years, round(c::DOUBLE / y, 2) AS citations_per_year, round(c::DOUBLE / n, 2) AS citations_per_document,
  h AS h_index, g AS g_index, gc AS g_index_cumulative, round(h::DOUBLE / y, 2) AS m_index FROM t"""


@query("impact_analysis", with_views("docs", "src") + _IMPACT.format(rel="src", frac="1.0::DOUBLE", extra="", m=3))
def _(spark, sf):
    return T.impact_analysis(corpus(spark, sf, "source_title"), "source_title", min_occ=3)


@query("impact_analysis_authors", with_views("docs", "au") + ", k AS (SELECT id, count(*) AS k FROM au GROUP BY id)" +
       _IMPACT.format(rel="au", frac="CAST(1.0::DOUBLE / k AS DECIMAL(38,12))", extra="JOIN k USING (id)", m=1))
def _(spark, sf):
    return T.impact_analysis(corpus(spark, sf, "authors"), "authors")


@query("collaboration_analysis", with_views("au") + """, k AS (SELECT id, count(*) AS k FROM au GROUP BY id)
SELECT term, count(*) AS num_documents, count(*) FILTER (k = 1) AS single, count(*) FILTER (k > 1) AS multi,
  round(count(*) FILTER (k > 1)::DOUBLE / greatest(count(*) FILTER (k = 1), 1), 2) AS ratio
FROM au JOIN k USING (id) GROUP BY term HAVING count(*) >= 5""")
def _(spark, sf):
    return T.collaboration_analysis(corpus(spark, sf, "authors"), "authors", min_occ=5)


@query("country_table", with_views("docs", "co") + """
SELECT term, count(*) AS num_documents, CAST(sum(cites) AS BIGINT) AS global_citations FROM docs JOIN co USING (id) GROUP BY term""")
def _(spark, sf):
    return T.country_table(corpus(spark, sf, "countries"))


@query("count_terms", with_views("au") + " SELECT count(DISTINCT term) AS num_terms FROM au")
def _(spark, sf):
    return T.count_terms(corpus(spark, sf, "authors"), "authors")


@query("distinct_terms", with_views("ik") + " SELECT DISTINCT term FROM ik")
def _(spark, sf):
    return T.distinct_terms(corpus(spark, sf, "index_keywords"), "index_keywords")


@query("keywords_coverage", with_views("docs", "kw") + """, r AS (
SELECT term, row_number() OVER (ORDER BY count(*) DESC, sum(cites) DESC, term) AS rank FROM docs JOIN kw USING (id) GROUP BY term),
b AS (SELECT id, min(rank) AS rank FROM kw JOIN r USING (term) WHERE rank <= 10 GROUP BY id),
a AS (SELECT rank, count(*) AS n FROM b GROUP BY rank)
SELECT term, rank, CAST(sum(coalesce(n, 0)) OVER (ORDER BY rank) AS BIGINT) AS cum_documents,
  round(100.0::DOUBLE * sum(coalesce(n, 0)) OVER (ORDER BY rank) / (SELECT count(DISTINCT id) FROM kw), 1) AS cum_pct
FROM r LEFT JOIN a USING (rank) WHERE rank <= 10""")
def _(spark, sf):
    c = corpus(spark, sf, "author_keywords")
    top = T.kept_terms(c, "author_keywords", 10)
    ranked = W.rank_in_group(top, [], T.sort_columns("num_documents")).select("term", "rank")
    return T.keywords_coverage(c, "author_keywords", ranked)


@query("activity_span", with_views("docs", "src") + """
SELECT term, min(year) AS first_year, max(year) AS last_year, CAST(max(year) - min(year) + 1 AS BIGINT) AS width,
  CAST(min(year) - (SELECT min(year) FROM docs) AS BIGINT) AS "offset" FROM docs JOIN src USING (id) GROUP BY term""")
def _(spark, sf):
    return T.activity_span(corpus(spark, sf, "source_title"), "source_title")


@query("active_flags", with_views("docs", "src") + """, c AS (SELECT DISTINCT term, year FROM docs JOIN src USING (id))
SELECT term, year, year = min(year) OVER (PARTITION BY term) AS is_first, year = max(year) OVER (PARTITION BY term) AS is_last FROM c""")
def _(spark, sf):
    cells = T.terms_by_year(corpus(spark, sf, "source_title"), "source_title").select("term", "year")
    return T.active_flags(cells)


# ----------------------------------------------------------- laws and summary

@query("core_authors", with_views("au") + """, w AS (SELECT term, count(*) AS k FROM au GROUP BY term),
a AS (SELECT k, count(*) AS n FROM w GROUP BY k), m AS (SELECT id, max(k) AS k FROM au JOIN w USING (term) GROUP BY id),
d AS (SELECT k, count(*) AS d FROM m GROUP BY k),
t AS (SELECT k, n, coalesce(d, 0) AS d, sum(n) OVER (ORDER BY k DESC) AS cn, sum(n) OVER () AS an,
  sum(coalesce(d, 0)) OVER (ORDER BY k DESC) AS cd, sum(coalesce(d, 0)) OVER () AS ad FROM a LEFT JOIN d USING (k))
SELECT k AS documents_written, n AS num_authors, round(100.0::DOUBLE * n / an, 2) AS pct_authors, CAST(cn AS BIGINT) AS cum_num_authors,
  round(100.0::DOUBLE * cn / an, 2) AS cum_pct_authors, d AS num_documents, round(100.0::DOUBLE * d / ad, 2) AS pct_documents,
  CAST(cd AS BIGINT) AS cum_num_documents, round(100.0::DOUBLE * cd / ad, 2) AS cum_pct_documents FROM t""")
def _(spark, sf):
    return L.core_authors(corpus(spark, sf, "authors"))


@query("lotka_theoretical", with_views("src") + """, w AS (SELECT term, count(*) AS k FROM src GROUP BY term),
a AS (SELECT k, count(*) AS n FROM w GROUP BY k)
SELECT k AS documents_written, n AS num_authors, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS pct_authors,
  round(100.0::DOUBLE * pow(k::DOUBLE, -2) / sum(pow(k::DOUBLE, -2)) OVER (), 2) AS theoretical_pct FROM a""")
def _(spark, sf):
    return L.lotka_theoretical(corpus(spark, sf, "source_title"), "source_title")


_LEVELS = """, p AS (SELECT source, count(*) AS k FROM docs GROUP BY 1), a AS (SELECT k, count(*) AS n FROM p GROUP BY k),
t AS (SELECT k, n, n * k AS d, sum(n) OVER (ORDER BY k DESC) AS cn, sum(n) OVER () AS an, sum(n * k) OVER (ORDER BY k DESC) AS cd,
  sum(n * k) OVER () AS ad, (SELECT count(*) FROM docs) // 3 AS third FROM a)"""
_ZONE = "CASE WHEN cd > 2 * third THEN 3 WHEN cd > third THEN 2 ELSE 1 END"


@query("core_sources", with_views("docs") + _LEVELS + f"""
SELECT k AS documents_published, n AS num_sources, round(100.0::DOUBLE * n / an, 2) AS pct_sources, CAST(cn AS BIGINT) AS cum_num_sources,
  round(100.0::DOUBLE * cn / an, 2) AS cum_pct_sources, d AS total_documents, CAST(cd AS BIGINT) AS cum_num_documents,
  round(100.0::DOUBLE * cd / ad, 2) AS cum_pct_documents, {_ZONE} AS bradford_group FROM t""")
def _(spark, sf):
    return L.core_sources(corpus(spark, sf, "source_title"))


@query("bradford_zones", with_views("docs") + _LEVELS + f"""
SELECT id, source AS source_title, {_ZONE} AS bradford_law_zone FROM docs JOIN p USING (source) JOIN t USING (k)""")
def _(spark, sf):
    return L.bradford_zones(corpus(spark, sf, "source_title")).select("id", "source_title", "bradford_law_zone")


@query("bradford_law", with_views("docs") + """, p AS (SELECT source, count(*) AS n, CAST(sum(cites) AS BIGINT) AS c FROM docs GROUP BY 1),
t AS (SELECT *, row_number() OVER w AS rank, CAST(sum(n) OVER (ORDER BY n DESC, c DESC, source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM p WINDOW w AS (ORDER BY n DESC, c DESC, source))
SELECT rank, source, n AS num_documents, c AS global_citations, cum AS cum_num_documents,
  cum <= (SELECT count(*) FROM docs) // 3 AS core FROM t""")
def _(spark, sf):
    return L.bradford_law(corpus(spark, sf, "source_title"))


@query("document_types", with_views("docs") + " SELECT dtype AS document_type, count(*) AS num_documents FROM docs GROUP BY 1")
def _(spark, sf):
    return S.document_types(corpus(spark, sf, "document_type"))


@query("coverage", with_views("docs", "au") + """, x AS (SELECT docs.*, EXISTS (SELECT 1 FROM au WHERE au.id = docs.id) AS a FROM docs),
c AS (SELECT 'id' AS "column", count(id) AS n FROM x UNION ALL SELECT 'year', count(year) FROM x
  UNION ALL SELECT 'global_citations', count(cites) FROM x UNION ALL SELECT 'authors', count(*) FILTER (a) FROM x
  UNION ALL SELECT 'document_type', count(dtype) FROM x)
SELECT "column", n AS num_values, round(100.0::DOUBLE * n / (SELECT count(*) FROM docs), 2) AS pct FROM c""")
def _(spark, sf):
    return S.coverage(corpus(spark, sf, "authors", "document_type"))


@query("descriptive_statistics", with_views("docs", "au", "co", "kw", "ik") + """,
k AS (SELECT docs.id, count(term) AS k FROM docs LEFT JOIN au USING (id) GROUP BY docs.id),
b AS (SELECT count(*)::DOUBLE AS n, min(year) AS a, max(year) AS z, sum(cites)::DOUBLE AS c,
  (SELECT count(*) FROM docs WHERE year = (SELECT min(year) FROM docs))::DOUBLE AS n0,
  (SELECT count(DISTINCT term) FROM au)::DOUBLE AS au, (SELECT count(*) FROM au)::DOUBLE AS app,
  (SELECT count(*) FROM k WHERE k = 1)::DOUBLE AS sd, (SELECT count(*) FROM k WHERE k > 1)::DOUBLE AS md,
  (SELECT count(DISTINCT term) FROM au JOIN k USING (id) WHERE k > 1)::DOUBLE AS ca,
  (SELECT count(DISTINCT source) FROM docs)::DOUBLE AS so, (SELECT count(DISTINCT term) FROM co)::DOUBLE AS co,
  (SELECT count(DISTINCT term) FROM kw)::DOUBLE AS kw, (SELECT count(DISTINCT term) FROM ik)::DOUBLE AS ik FROM docs)
SELECT 'general' AS category, 'documents' AS metric, n AS value FROM b
UNION ALL SELECT 'general', 'first_year', a FROM b UNION ALL SELECT 'general', 'last_year', z FROM b
UNION ALL SELECT 'general', 'compound_annual_growth_rate', round(100.0::DOUBLE * (pow(n / n0, 1.0::DOUBLE / (z - a + 1)) - 1), 2) FROM b
UNION ALL SELECT 'general', 'citations_per_document', round(c / n, 2) FROM b
UNION ALL SELECT 'general', 'citations_per_document_per_year', round(c / (n * (z - a + 1)), 2) FROM b
UNION ALL SELECT 'general', 'documents_per_source', round(n / so, 2) FROM b
UNION ALL SELECT 'authors', 'author_appearances', app FROM b
UNION ALL SELECT 'authors', 'documents_per_author', round(n / au, 2) FROM b
UNION ALL SELECT 'authors', 'authors_per_document', round(au / n, 2) FROM b
UNION ALL SELECT 'authors', 'single_authored_documents', sd FROM b
UNION ALL SELECT 'authors', 'multi_authored_documents', md FROM b
UNION ALL SELECT 'authors', 'co_authors_per_document', round(app / n, 2) FROM b
UNION ALL SELECT 'authors', 'collaboration_index', round(ca / md, 2) FROM b
UNION ALL SELECT 'authors', 'distinct_authors', au FROM b UNION ALL SELECT 'authors', 'distinct_countries', co FROM b
UNION ALL SELECT 'keywords', 'distinct_author_keywords', kw FROM b UNION ALL SELECT 'keywords', 'distinct_index_keywords', ik FROM b
UNION ALL SELECT 'general', 'distinct_source_title', so FROM b
UNION ALL SELECT 'document types', dtype, count(*)::DOUBLE FROM docs GROUP BY dtype""")
def _(spark, sf):
    return S.descriptive_statistics(corpus(
        spark, sf, "authors", "countries", "author_keywords", "index_keywords", "source_title", "document_type"))


# ------------------------------------------------------------ windows, sorts

@query("cumulative", """SELECT s_suppkey, round(sum(s_acctbal) OVER (ORDER BY s_name ROWS UNBOUNDED PRECEDING), 2) AS cum FROM supplier""")
def _(spark, sf):
    out = W.cumulative(table(spark, sf, "supplier"), "s_acctbal", [F.col("s_name")])
    return out.select("s_suppkey", F.round("cum", 2).alias("cum"))


@query("rank_in_group", with_views("docs", "kw") + """
SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY cites DESC, id) AS rank FROM docs JOIN kw USING (id)""")
def _(spark, sf):
    dt = I.doc_terms(corpus(spark, sf, "author_keywords"), "author_keywords", ["global_citations"])
    return W.rank_in_group(dt, ["term"], [F.col("global_citations").desc(), F.col("id")]).select("term", "id", "rank")


@query("ordinal_in_group", """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ordinal FROM events""")
def _(spark, sf):
    return W.ordinal_in_group(table(spark, sf, "events"), ["event_type"], [F.col("ts"), F.col("event_id")]).select(
        "event_id", "ordinal")


@query("share_of", with_views("docs", "kw") + """, c AS (SELECT term, year, count(*) AS n FROM docs JOIN kw USING (id) GROUP BY ALL)
SELECT term, year, round(n::DOUBLE / sum(n) OVER (PARTITION BY year), 6) AS share FROM c""")
def _(spark, sf):
    cells = T.terms_by_year(corpus(spark, sf, "author_keywords"), "author_keywords")
    return W.share_of(cells, "num_documents", ["year"]).select("term", "year", F.round("share", 6).alias("share"))


@query("increment", with_views("docs") + """, y AS (SELECT year, count(*) AS n FROM docs GROUP BY year)
SELECT year, n AS num_documents, n - lag(n, 1, 0) OVER (ORDER BY year) AS increment FROM y""")
def _(spark, sf):
    years = T.time_analysis(corpus(spark, sf)).select("year", "num_documents")
    return W.increment(years, "num_documents", [F.col("year")])


@query("sort_terms", with_views("docs", "src") + """
SELECT term, count(*) AS num_documents, CAST(sum(cites) AS BIGINT) AS global_citations FROM docs JOIN src USING (id) GROUP BY term""")
def _(spark, sf):
    return T.sort_terms(T.term_counters(corpus(spark, sf, "source_title"), "source_title"), "global_citations")


@query("top_terms", with_views("docs", "src") + """
SELECT term, count(*) AS num_documents, CAST(sum(cites) AS BIGINT) AS global_citations
FROM docs JOIN src USING (id) GROUP BY term ORDER BY 2 DESC, 3 DESC, 1 LIMIT 30""")
def _(spark, sf):
    return T.top_terms(T.term_counters(corpus(spark, sf, "source_title"), "source_title"), k=30, resort="global_citations")


@query("top_documents", with_views("docs") + """
SELECT id, year, cites AS global_citations, cites AS metric FROM docs ORDER BY cites DESC, id LIMIT 50""")
def _(spark, sf):
    return T.top_documents(corpus(spark, sf)).select("id", "year", "global_citations", "metric")


@query("top_documents_normalized", with_views("docs", "placed", "edges") + _LOCAL + """
SELECT id, year, coalesce(local, 0) AS local_citations,
  round(coalesce(local, 0)::DOUBLE / ((SELECT max(year) FROM docs) - year + 1), 3) AS metric
FROM docs LEFT JOIN lc USING (id) ORDER BY 4 DESC, id LIMIT 25""")
def _(spark, sf):
    return T.top_documents(with_local_citations(spark, sf), 25, "local", normalized=True).select(
        "id", "year", "local_citations", "metric")


# ----------------------------------------------------------------------- sets

@query("vocabulary", with_views("kw", "ik") + " SELECT term FROM kw UNION SELECT term FROM ik")
def _(spark, sf):
    return ST.vocabulary(corpus(spark, sf, "author_keywords", "index_keywords"), ["author_keywords", "index_keywords"])


@query("tokens_in_vocabulary", """
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS term FROM part),
p AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS term FROM part)
SELECT p_partkey AS id, string_agg(DISTINCT w.term, ';' ORDER BY w.term) AS tokens
FROM part LEFT JOIN p ON p.id = p_partkey LEFT JOIN w USING (term) GROUP BY p_partkey""")
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    vocab = parts.select(F.split("p_name", " ")[1].alias("term"))
    return ST.tokens_in_vocabulary(parts, "p_name", vocab).select("id", F.array_join("tokens", ";").alias("tokens"))


@query("new_terms", """
WITH b AS (SELECT DISTINCT min(p_name) AS t FROM part GROUP BY p_brand)
SELECT DISTINCT p_name AS term FROM part WHERE p_name NOT IN (SELECT t FROM b)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    thesaurus = p.groupBy(F.col("p_brand").alias("canonical")).agg(F.min("p_name").alias("variant"))
    return ST.new_terms(p.select(F.col("p_name").alias("term")), thesaurus)


@query("dag_sources", with_views("placed", "edges") + """
SELECT DISTINCT cited AS node FROM edges WHERE cited NOT IN (SELECT citing FROM edges)""")
def _(spark, sf):
    return ST.dag_sources(citation_edges(spark, sf).select(F.col("cited").alias("src"), F.col("citing").alias("dst")))


@query("concat_corpora", with_views("docs") + """
SELECT id, year, dtype AS document_type, NULL::VARCHAR AS source_title FROM docs WHERE year < 1998
UNION ALL SELECT id, year, NULL, source FROM docs WHERE year >= 1998""")
def _(spark, sf):
    from corpuscope.sources.corpus import concat_corpora
    a = corpus(spark, sf, "document_type").where("year < 1998").drop("global_citations")
    b = corpus(spark, sf, "source_title").where("year >= 1998").drop("global_citations")
    return concat_corpora([a, b])


_FP = r"""array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(
  {strip}(regexp_replace(replace(lower(trim({c}, E' \n\t\r')), '-', ' '), '[!"#$%&''()*+,./:;<=>?@\[\]^_`{{|}}~-]', '', 'g')), '[ \n\t\r]+'), lambda x: x <> ''))), ' ')"""


@query("drop_duplicate_records", "WITH f AS (SELECT doc_id, " + _FP.format(c="text", strip="strip_accents") + """ AS k FROM documents)
SELECT min(doc_id) AS id FROM f GROUP BY k""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return ST.drop_duplicate_records(d, "text").select("id")


@query("shared_terms", with_views("docs", "ik") + """, a AS (SELECT DISTINCT term FROM ik JOIN docs USING (id) WHERE year < 1998),
b AS (SELECT DISTINCT term FROM ik JOIN docs USING (id) WHERE year >= 1998) SELECT term FROM a INTERSECT SELECT term FROM b""")
def _(spark, sf):
    c = corpus(spark, sf, "index_keywords")
    return ST.shared_terms(c.where("year < 1998"), c.where("year >= 1998"), "index_keywords")


@query("documents_without", with_views("docs", "au") + """, a AS (SELECT 'Supplier#' || lpad((7 * c_custkey)::VARCHAR, 9, '0') AS term FROM customer)
SELECT id FROM docs WHERE id NOT IN (SELECT id FROM au JOIN a USING (term))""")
def _(spark, sf):
    name = F.concat(F.lit("Supplier#"), F.lpad((7 * F.col("c_custkey")).cast("string"), 9, "0"))
    other = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array(name).alias("authors"))
    return ST.documents_without(corpus(spark, sf, "authors"), other, "authors").select("id")
