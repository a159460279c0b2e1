"""Queries that write a corpus or a thesaurus and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.plans.lineage import scratch_path
from corpuscope.sources import corpus as SC
from corpuscope.sources import terms as ST

from .textual import brand_groups
from .views import corpus, table, with_views

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


_ROUND_TRIP = with_views("docs", "au") + """
SELECT docs.id, year, cites AS global_citations, dtype AS document_type, string_agg(term, ';' ORDER BY term) AS authors
FROM docs LEFT JOIN au USING (id) GROUP BY ALL"""


def _shape(df):
    return df.select("id", "year", "global_citations", "document_type",
                     F.array_join(F.array_sort("authors"), ";").alias("authors"))


@query("read_csv_export", with_views("docs", "au") + """
SELECT year, cites AS global_citations, dtype || ' "q"' || chr(10) || 'x' AS document_type, string_agg(term, ';' ORDER BY term) AS authors
FROM docs LEFT JOIN au USING (id) GROUP BY id, year, cites, dtype""")
def _(spark, sf):
    c = corpus(spark, sf, "authors", "document_type")
    path = scratch_path(spark)
    # Quotes, line breaks and a column no tag map knows.
    c.select(F.array_join("authors", "; ").alias("Authors"), F.col("year").alias("Year"), F.col("global_citations").alias("Cited by"),
             F.concat("document_type", F.lit(' "q"\nx')).alias("Document Type"), F.lit("x").alias("Link")).write.option(
        "header", True).option("escape", '"').csv(path)
    out = SC.read_corpus(spark, path, "csv", columns=["Authors", "Year", "Cited by", "Document Type", "Link"])
    return out.select("year", "global_citations", "document_type", F.array_join(F.array_sort("authors"), ";").alias("authors"))


@query("apply_tag_map", "SELECT s_name AS title, s_suppkey AS year FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("TI"), F.col("s_suppkey").alias("PY"), F.col("s_acctbal").alias("U1"))
    return SC.apply_tag_map(s, SC.WOS_TAGS)


@query("write_corpus_parquet", _ROUND_TRIP)
def _(spark, sf):
    path = scratch_path(spark)
    SC.write_corpus(corpus(spark, sf, "authors", "document_type"), path)
    return _shape(SC.read_corpus(spark, path, "parquet"))


@query("json_records", _ROUND_TRIP)
def _(spark, sf):
    path = scratch_path(spark)
    SC.write_corpus(corpus(spark, sf, "authors", "document_type"), path, "json")
    return _shape(SC.read_corpus(spark, path, "json"))


_GROUPS = "SELECT DISTINCT 'Group#' || (CAST(substr(p_brand, 7) AS INTEGER) % 5) AS canonical, p_brand AS variant FROM part"


@query("read_thesaurus", _GROUPS + " UNION SELECT c_mktsegment, c_name FROM customer")
def _(spark, sf):
    path = scratch_path(spark)
    customers = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("canonical"), F.col("c_name").alias("variant"))
    ST.write_thesaurus(brand_groups(spark, sf).unionByName(customers), path)
    return ST.read_thesaurus(spark, path)


@query("write_thesaurus_parquet", _GROUPS)
def _(spark, sf):
    path = scratch_path(spark)
    ST.write_thesaurus(brand_groups(spark, sf), path, "parquet")
    return spark.read.parquet(path)


@query("read_terms", "SELECT DISTINCT p_name AS term FROM part")
def _(spark, sf):
    path = scratch_path(spark)
    names = table(spark, sf, "part").select(F.concat(F.lit("  "), "p_name").alias("value")).distinct()
    names.union(names.agg(F.lit("   "))).write.text(path)
    return ST.read_terms(spark, path)
