"""Queries on networks, communities and main paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import graph as G
from corpuscope.operators import matrix as M
from corpuscope.operators import terms as T
from corpuscope.plans.lineage import materialise

from .views import citation_edges, corpus, with_views

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def author_network(spark, sf):
    co = materialise(M.co_occurrence(corpus(spark, sf, "authors"), "authors", 60))
    return M.network_edges(M.normalize(co, "salton"), 0.045)


def links(spark, sf):
    """Citation links from cited to citing."""
    return citation_edges(spark, sf).select(F.col("cited").alias("src"), F.col("citing").alias("dst"))


@query("label_propagation")
def _(spark, sf):
    return G.label_propagation(author_network(spark, sf), weighted=True)


@query("connected_components", with_views("placed", "edges") + """
SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cluster FROM orders
WHERE o_orderkey IN (SELECT citing FROM edges UNION SELECT cited FROM edges)""")
def _(spark, sf):
    return G.connected_components(citation_edges(spark, sf).toDF("t1", "t2"))


@query("louvain")
def _(spark, sf):
    return G.louvain(author_network(spark, sf))


@query("citation_communities")
def _(spark, sf):
    return G.citation_communities(corpus(spark, sf), materialise(citation_edges(spark, sf)))


_PATHS = """, f AS (SELECT node, count(*) AS n FROM (SELECT * FROM fp) GROUP BY node), b AS (SELECT node, count(*) AS n FROM (SELECT * FROM bp) GROUP BY node),
l AS (SELECT cited AS src, citing AS dst, f.n * b.n AS c FROM edges JOIN f ON f.node = cited JOIN b ON b.node = citing)"""
_REC = with_views("placed", "edges", recursive=True) + """,
fp(node) AS (SELECT DISTINCT cited FROM edges WHERE cited NOT IN (SELECT citing FROM edges) UNION ALL SELECT citing FROM fp JOIN edges ON cited = node),
bp(node) AS (SELECT DISTINCT citing FROM edges WHERE citing NOT IN (SELECT cited FROM edges) UNION ALL SELECT cited FROM bp JOIN edges ON citing = node)""" + _PATHS


@query("path_counts", _REC + " SELECT src, dst, CAST(c AS BIGINT) AS count FROM l")
def _(spark, sf):
    return G.path_counts(links(spark, sf)).withColumn("count", F.col("count").cast("bigint"))


_MAIN = _REC + """, fv(node, v) AS (SELECT DISTINCT src, 0::HUGEINT FROM l WHERE src NOT IN (SELECT dst FROM l) UNION SELECT dst, v + c FROM fv JOIN l ON src = node),
bv(node, v) AS (SELECT DISTINCT dst, 0::HUGEINT FROM l WHERE dst NOT IN (SELECT src FROM l) UNION SELECT src, v + c FROM bv JOIN l ON dst = node),
mf AS (SELECT node, max(v) AS v FROM fv GROUP BY node), mb AS (SELECT node, max(v) AS v FROM bv GROUP BY node),
s AS (SELECT src, dst, c, fs.v AS fsrc, fd.v AS fdst, bs.v AS bsrc, bd.v AS bdst, fs.v + c + bd.v AS t FROM l JOIN mf fs ON fs.node = src JOIN mf fd ON fd.node = dst
  JOIN mb bs ON bs.node = src JOIN mb bd ON bd.node = dst),
ch AS (SELECT * FROM s WHERE c = (SELECT max(c) FROM s) OR t = (SELECT max(t) FROM s)),
up(src, dst, c) AS (SELECT src, dst, c FROM ch UNION SELECT s.src, s.dst, s.c FROM s JOIN up ON s.dst = up.src WHERE s.fsrc + s.c = s.fdst),
dn(src, dst, c) AS (SELECT src, dst, c FROM ch UNION SELECT s.src, s.dst, s.c FROM s JOIN dn ON s.src = dn.dst WHERE s.c + s.bdst = s.bsrc)"""


@query("main_path", _MAIN + """
SELECT src, dst, CAST(c AS BIGINT) AS count FROM up UNION SELECT src, dst, CAST(c AS BIGINT) FROM dn""")
def _(spark, sf):
    return G.main_path(links(spark, sf)).withColumn("count", F.col("count").cast("bigint"))


@query("main_path_nodes", _MAIN + """, nodes AS (SELECT src AS id FROM up UNION SELECT dst FROM up UNION SELECT src FROM dn UNION SELECT dst FROM dn)
SELECT id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN nodes ON o_orderkey = id""")
def _(spark, sf):
    return G.main_path_nodes(corpus(spark, sf), G.main_path(links(spark, sf))).select("id", "year")
