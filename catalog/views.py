"""The driver tables seen as a corpus, in Spark and as SQL.

An order is a document: its year, its customer as source, its priority as
document type, the suppliers of its lines as authors (first author: the supplier
of the first line), their nations as countries, brands as author keywords and
part names as index keywords.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.plans.lineage import spread
from corpuscope.plans.running import ordinal

_LISTS = {"authors", "countries", "author_keywords", "index_keywords", "affiliations"}


#: Tables of long texts, whose work per row is large.
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, _TEXTS[name]) if name in _TEXTS else df


def _first_then_rest(first: Column, names: Column) -> Column:
    """Distinct names with the one of the first line in front."""
    return F.concat(F.array(first), F.array_except(F.array_sort(names), F.array(first)))


def corpus(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The corpus with ``id``, ``year``, ``global_citations`` and the wanted columns only."""
    want = set(cols)
    orders = table(spark, sf, "orders")
    docs = orders.select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").alias("year"),
        (F.floor("o_totalprice").cast("bigint") % 100).alias("global_citations"),
        F.col("o_custkey").alias("_cust"),
        F.col("o_orderpriority").alias("document_type"),
    )
    if "source_title" in want:
        customer = table(spark, sf, "customer").select(
            F.col("c_custkey").alias("_cust"), F.col("c_name").alias("source_title")
        )
        docs = docs.join(customer, "_cust")
    if want & _LISTS:
        lines = table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("id"), "l_linenumber", "l_suppkey", "l_partkey"
        )
        aggs = []
        if want & {"authors", "countries", "affiliations"}:
            supplier = table(spark, sf, "supplier")
            if want & {"countries", "affiliations"}:
                supplier = supplier.join(
                    table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
                )
            lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            lead = F.struct("l_linenumber", "s_name")
            if "authors" in want:
                aggs.append(
                    _first_then_rest(F.min_by("s_name", lead), F.collect_set("s_name")).alias("authors")
                )
            if "countries" in want:
                aggs.append(
                    _first_then_rest(F.min_by("n_name", lead), F.collect_set("n_name")).alias("countries")
                )
            if "affiliations" in want:
                place = F.concat(
                    F.lit("Dept of Supply, University of "), "s_name", F.lit(", "), "n_name"
                )
                aggs.append(
                    _first_then_rest(F.min_by(place, lead), F.collect_set(place)).alias("affiliations")
                )
        if want & {"author_keywords", "index_keywords"}:
            lines = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
            if "author_keywords" in want:
                aggs.append(F.array_sort(F.collect_set("p_brand")).alias("author_keywords"))
            if "index_keywords" in want:
                aggs.append(F.array_sort(F.collect_set("p_name")).alias("index_keywords"))
        docs = docs.join(lines.groupBy("id").agg(*aggs), "id", "left")
    keep = ["id", "year", "global_citations", *[c for c in cols if c not in ("global_citations", "year")]]
    if "title" in want:
        docs = docs.withColumn("title", F.concat(F.lit("Order number "), F.col("id"), F.lit(" of the year "), F.col("year")))
    return docs.select(*keep)


def citation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(citing, cited): an order cites the previous and third-previous order of its customer."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    placed = ordinal(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "k")
    citing = placed.select("o_custkey", F.col("o_orderkey").alias("citing"), F.explode(
        F.array(F.col("k") - 1, F.col("k") - 3)
    ).alias("k"))
    cited = placed.select("o_custkey", "k", F.col("o_orderkey").alias("cited"))
    return citing.join(cited, ["o_custkey", "k"]).select("citing", "cited")


# The same views as common table expressions.
CTE = {
    "docs": """docs AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(floor(o_totalprice) AS BIGINT) % 100 AS cites,
         o_orderpriority AS dtype, c_name AS source
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "au": """au AS (
  SELECT DISTINCT l_orderkey AS id, s_name AS term FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "co": """co AS (
  SELECT DISTINCT l_orderkey AS id, n_name AS term FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
    "kw": """kw AS (
  SELECT DISTINCT l_orderkey AS id, p_brand AS term FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "ik": """ik AS (
  SELECT DISTINCT l_orderkey AS id, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "src": """src AS (SELECT o_orderkey AS id, c_name AS term FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "placed": """placed AS (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k
  FROM orders)""",
    "edges": """edges AS (
  SELECT a.o_orderkey AS citing, b.o_orderkey AS cited
  FROM placed a JOIN placed b ON a.o_custkey = b.o_custkey AND (b.k = a.k - 1 OR b.k = a.k - 3))""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause holding the named views."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(CTE[n] for n in names)
