"""Queries on matrices, factorizations and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions import items as I
from corpuscope.operators import cluster as K
from corpuscope.operators import factor as D
from corpuscope.operators import graph as G
from corpuscope.operators import linkage as L
from corpuscope.operators import matrix as M
from corpuscope.operators import terms as T
from corpuscope.plans import analyses as A
from corpuscope.plans.lineage import materialise

from .textual import texts
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


def _round(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def brands(spark, sf, *more):
    return corpus(spark, sf, "author_keywords", *more)


# ------------------------------------------------------------------- matrices

@query("tf", with_views("ik") + """, k AS (SELECT term FROM ik GROUP BY term HAVING count(*) >= 800 AND count(*) < 950)
SELECT id, term, round(ln(2), 6) AS tf FROM ik JOIN k USING (term)""")
def _(spark, sf):
    return _round(M.tf(corpus(spark, sf, "index_keywords"), "index_keywords", "log", 800, 950), "tf")


def _tfidf_sql(norm, top):
    n = {"l2": "w / sqrt(sum(w * w) OVER (PARTITION BY id))", "l1": "w / sum(abs(w)) OVER (PARTITION BY id)", None: "w"}[norm]
    return with_views("kw") + f""", n AS (SELECT count(DISTINCT id) AS n FROM kw), d AS (SELECT term, count(*) AS d FROM kw GROUP BY term),
w AS (SELECT id, term, ln((1.0::DOUBLE + n) / (1 + d)) + 1 AS w FROM kw JOIN d USING (term), n), x AS (SELECT id, term, {n} AS w FROM w),
t AS (SELECT term FROM x GROUP BY term ORDER BY round(sum(w), 9) DESC, term LIMIT {top})
"""


@query("tfidf", _tfidf_sql("l2", 10) + "SELECT id, term, round(w, 6) AS tfidf FROM x JOIN t USING (term)")
def _(spark, sf):
    return _round(M.tfidf(M.tf(brands(spark, sf), "author_keywords"), max_items=10), "tfidf")


@query("tfidf_ranking", _tfidf_sql("l1", 20) + "SELECT term, round(sum(w), 4) AS tfidf FROM x JOIN t USING (term) GROUP BY term")
def _(spark, sf):
    return _round(M.tfidf_ranking(M.tfidf(M.tf(brands(spark, sf), "author_keywords"), norm="l1"), 20), "tfidf", places=4)


_TOP = """, top AS (SELECT term, count(*) AS d, sum(cites) AS c FROM docs JOIN {rel} USING (id) GROUP BY term ORDER BY 2 DESC, 3 DESC, 1 LIMIT {k})"""


def _co(rel="kw", k=12):
    return with_views("docs", rel) + _TOP.format(rel=rel, k=k) + f""", r AS (SELECT id, term FROM {rel} JOIN top USING (term)),
co AS (SELECT a.term AS t1, b.term AS t2, count(*) AS n FROM r a JOIN r b USING (id) GROUP BY ALL)"""


@query("co_occurrence", _co("au", 40) + " SELECT t1, t2, n FROM co")
def co_occurrence(spark, sf):
    return M.co_occurrence(corpus(spark, sf, "authors"), "authors", max_items=40)


@query("bigraph", with_views("docs", "kw", "co") + _TOP.format(rel="kw", k=10) + """, top2 AS (SELECT term, count(*) AS d, sum(cites) AS c FROM docs JOIN co USING (id) GROUP BY term ORDER BY 2 DESC, 3 DESC, 1 LIMIT 8)
SELECT kw.term, co.term AS "by", count(*) AS n FROM kw JOIN co USING (id) WHERE kw.term IN (SELECT term FROM top) AND co.term IN (SELECT term FROM top2) GROUP BY ALL""")
def _(spark, sf):
    return M.bigraph(brands(spark, sf, "countries"), "author_keywords", "countries", 10, 8)


@query("top_axes", with_views("kw", "co") + """, c AS (SELECT kw.term, co.term AS "by", count(*) AS n FROM kw JOIN co USING (id) GROUP BY ALL),
a AS (SELECT term FROM c GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 5), d AS (SELECT * FROM c WHERE term IN (SELECT term FROM a)),
b AS (SELECT "by" FROM d GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 6)
SELECT term, "by", n FROM d WHERE "by" IN (SELECT "by" FROM b)""")
def _(spark, sf):
    return M.bigraph(brands(spark, sf, "countries"), "author_keywords", "countries", 5, 6, top_data=True)


@query("sort_axis", _co() + """, m AS (SELECT t1, max(n) AS m FROM co GROUP BY 1), p AS (SELECT t1, row_number() OVER (ORDER BY m DESC, t1) AS position FROM m)
SELECT t1, t2, n, CAST(position AS INTEGER) AS position FROM co JOIN p USING (t1)""")
def _(spark, sf):
    return M.sort_axis(M.co_occurrence(brands(spark, sf), "author_keywords", 12), by="data", ascending=False, axis="t1")


_FORMULAS = {
    "jaccard": "n / (a + b - n)", "dice": "2 * n / (a + b)", "dice_ref": "n / (a + b + 2 * n)", "salton": "n / sqrt(a * b)",
    "equivalence": "n * n / (a * b)", "inclusion": "n / least(a, b)",
    "mutual_information": "ln((SELECT count(*) FROM docs) * n / (a * b))",
    "mutual_information_ref": "ln(n / (12 * a * b))", "association": "n / (a * b)",
}


def _normal(method):
    return f""", v AS (SELECT t1, t2, {_FORMULAS[method]} AS value FROM (SELECT co.t1, co.t2, co.n::DOUBLE AS n, x.n::DOUBLE AS a, y.n::DOUBLE AS b
FROM co JOIN co x ON x.t1 = co.t1 AND x.t2 = co.t1 JOIN co y ON y.t1 = co.t2 AND y.t2 = co.t2))"""


def _register_normal(method):
    @query(f"normalize_{method}", _co() + _normal(method) + " SELECT t1, t2, round(value, 9) AS value FROM v")
    def _(spark, sf):
        c = brands(spark, sf)
        total = c.agg(F.count(F.lit(1))).scalar()
        out = M.normalize(M.co_occurrence(c, "author_keywords", 12), method, total)
        return _round(out.select("t1", "t2", "value"), "value", places=9)


for _m in _FORMULAS:
    _register_normal(_m)


_PHI = _co() + """, g AS (SELECT count(DISTINCT id)::DOUBLE AS g FROM kw), p AS (SELECT x.term AS t1, y.term AS t2, x.d::DOUBLE AS n1, y.d::DOUBLE AS n2, coalesce(n, 0)::DOUBLE AS n, g
FROM top x JOIN top y ON x.term < y.term LEFT JOIN co ON co.t1 = x.term AND co.t2 = y.term, g),
phi AS (SELECT t1, t2, (g * n - n1 * n2) / sqrt(n1 * (g - n1) * n2 * (g - n2)) AS value FROM p)"""


@query("auto_correlation", _PHI + " SELECT t1, t2, round(value, 9) AS value FROM phi")
def _(spark, sf):
    return _round(M.auto_correlation(brands(spark, sf), "author_keywords", 12), "value", places=9)


_DENSE = with_views("docs", "kw", "co") + _TOP.format(rel="kw", k=8) + """, top2 AS (SELECT term, count(*) AS d, sum(cites) AS c FROM docs JOIN co USING (id) GROUP BY term ORDER BY 2 DESC, 3 DESC, 1 LIMIT 14),
cc AS (SELECT kw.term, co.term AS b, count(*) AS n FROM kw JOIN co USING (id) GROUP BY ALL),
m AS (SELECT top.term, top2.term AS b, coalesce(n, 0)::DOUBLE AS n FROM top CROSS JOIN top2 LEFT JOIN cc ON cc.term = top.term AND cc.b = top2.term)"""


def _cross(method, sql):
    @query(f"cross_correlation_{method}", _DENSE + sql)
    def _(spark, sf):
        out = M.cross_correlation(brands(spark, sf, "countries"), "author_keywords", "countries", method, 8, 14)
        return _round(out, "value")


_cross("pearson", " SELECT x.term AS t1, y.term AS t2, round(corr(x.n, y.n), 6) AS value FROM m x JOIN m y USING (b) WHERE x.term < y.term GROUP BY ALL")
_cross("spearman", """, r AS (SELECT term, b, rank() OVER (PARTITION BY term ORDER BY n) + (count(*) OVER (PARTITION BY term, n) - 1) / 2.0 AS n FROM m)
SELECT x.term AS t1, y.term AS t2, round(corr(x.n::DOUBLE, y.n::DOUBLE), 6) AS value FROM r x JOIN r y USING (b) WHERE x.term < y.term GROUP BY ALL""")
_cross("kendall", """, s AS (SELECT x.term, x.b AS b1, y.b AS b2, sign(x.n - y.n)::DOUBLE AS s FROM m x JOIN m y ON x.term = y.term AND x.b < y.b)
SELECT x.term AS t1, y.term AS t2, round(sum(x.s * y.s) / sqrt(sum(abs(x.s)) * sum(abs(y.s))), 6) AS value FROM s x JOIN s y USING (b1, b2) WHERE x.term < y.term GROUP BY ALL""")


@query("link_classes", _PHI + " SELECT t1, t2, CASE WHEN value > 0.75 THEN 4 WHEN value > 0.5 THEN 3 WHEN value > 0.25 THEN 2 ELSE 1 END AS link_class FROM phi")
def _(spark, sf):
    return M.link_classes(M.auto_correlation(brands(spark, sf), "author_keywords", 12)).select("t1", "t2", "link_class")


@query("associates", with_views("docs", "ik") + """, c AS (SELECT a.term AS keyword, b.term, count(*) AS n FROM ik a JOIN ik b USING (id)
WHERE a.term IN ('red bolt', 'old ring') AND a.term <> b.term GROUP BY ALL),
t AS (SELECT term, count(*) AS d, sum(cites) AS s FROM docs JOIN ik USING (id) WHERE term IN (SELECT term FROM c) GROUP BY term ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15)
SELECT keyword, term, n FROM c WHERE term IN (SELECT term FROM t)""")
def _(spark, sf):
    return M.associates(corpus(spark, sf, "index_keywords"), "index_keywords", ["red bolt", "old ring"], 15)


@query("compare_keywords", with_views("docs", "kw") + """, c AS (SELECT a.term AS keyword, b.term, count(*) AS n FROM kw a JOIN kw b USING (id)
WHERE a.term IN ('Brand#3', 'Brand#4') AND a.term <> b.term GROUP BY ALL)
SELECT term, CAST(sum(CASE WHEN keyword = 'Brand#3' THEN n ELSE 0 END) AS BIGINT) AS with_a, CAST(sum(CASE WHEN keyword = 'Brand#4' THEN n ELSE 0 END) AS BIGINT) AS with_b FROM c GROUP BY term""")
def _(spark, sf):
    return M.compare_keywords(brands(spark, sf), "author_keywords", "Brand#3", "Brand#4")


def brand_clusters(c):
    """Five clusters of the brands on the axis, by their number."""
    return T.kept_terms(c, "author_keywords", 12).select(
        F.concat(F.lit("CL_"), F.substring("term", 7, 9).cast("int") % 5).alias("cluster"), "term")


_CL = ", cl AS (SELECT term, 'CL_' || (CAST(substr(term, 7) AS INTEGER) % 5) AS cluster FROM top)"


@query("contingency", with_views("docs", "kw") + "SELECT dtype AS cluster, term, count(*)::DOUBLE AS value FROM docs JOIN kw USING (id) GROUP BY ALL")
def _(spark, sf):
    c = brands(spark, sf, "document_type")
    return M.contingency(M.tf(c, "author_keywords", "binary"), c.select("id", F.col("document_type").alias("cluster")))


_CC = _co() + _normal("equivalence") + _CL + """, m AS (SELECT x.cluster AS c1, y.cluster AS c2, sum(value) AS value FROM v JOIN cl x ON x.term = t1 JOIN cl y ON y.term = t2 GROUP BY ALL)"""


def _equivalence(spark, sf):
    c = brands(spark, sf)
    return c, M.normalize(M.co_occurrence(c, "author_keywords", 12), "equivalence")


@query("cluster_co_occurrence", _CC + " SELECT c1, c2, round(value, 6) AS value FROM m")
def _(spark, sf):
    c, edges = _equivalence(spark, sf)
    return _round(M.cluster_co_occurrence(edges, brand_clusters(c)), "value")


@query("strategic_map", _CC + """, s AS (SELECT c2 AS cluster, sum(CASE WHEN c1 = c2 THEN value ELSE 0 END) AS d, sum(CASE WHEN c1 <> c2 THEN value ELSE 0 END) AS c FROM m GROUP BY 1),
q AS (SELECT median(d) AS md, median(c) AS mc FROM s)
SELECT cluster, round(d, 6) AS density, round(c, 6) AS centrality, CASE WHEN d >= md - 1e-12 AND c >= mc - 1e-12 THEN 'motor' WHEN d >= md - 1e-12 THEN 'niche' WHEN c >= mc - 1e-12 THEN 'basic' ELSE 'emerging or declining' END AS quadrant FROM s, q""")
def _(spark, sf):
    c, edges = _equivalence(spark, sf)
    return _round(M.strategic_map(edges, brand_clusters(c)), "density", "centrality")


@query("dissimilarity", _co() + _normal("salton") + """ SELECT x.term AS t1, y.term AS t2, round(CASE WHEN x.term = y.term THEN 0 ELSE 1 - coalesce(value, 0) END, 6) AS value
FROM top x CROSS JOIN top y LEFT JOIN v ON v.t1 = x.term AND v.t2 = y.term""")
def _(spark, sf):
    co = M.co_occurrence(brands(spark, sf), "author_keywords", 12)
    return _round(M.dissimilarity(M.normalize(co, "salton")), "value")


@query("network_edges", _co() + _normal("jaccard") + " SELECT t1, t2, round(value, 6) AS value FROM v WHERE t1 < t2 AND value > 0.1")
def _(spark, sf):
    co = M.co_occurrence(brands(spark, sf), "author_keywords", 12)
    return _round(M.network_edges(M.normalize(co, "jaccard"), 0.1), "value")


# ------------------------------------------------------------- factorizations

def _priority_cells(spark, sf):
    c = brands(spark, sf, "document_type")
    return materialise(M.contingency(M.tf(c, "author_keywords"), c.select("id", F.col("document_type").alias("cluster"))))


@query("correspondence_analysis")
def _(spark, sf):
    return D.correspondence_analysis(_priority_cells(spark, sf), "cluster", "term", "value")["cols"]


@query("correspondence_analysis_inertia", with_views("docs", "kw") + """, c AS (SELECT dtype, term, count(*)::DOUBLE AS x FROM docs JOIN kw USING (id) GROUP BY ALL),
p AS (SELECT dtype, term, x / sum(x) OVER () AS p, sum(x) OVER (PARTITION BY dtype) / sum(x) OVER () AS r, sum(x) OVER (PARTITION BY term) / sum(x) OVER () AS c FROM c)
SELECT round(sum((p - r * c) * (p - r * c) / (r * c)), 9) AS inertia FROM p""")
def _(spark, sf):
    axes = D.correspondence_analysis(_priority_cells(spark, sf), "cluster", "term", "value", 25)["axes"]
    return axes.agg(F.round(F.sum("eigenvalue"), 9).alias("inertia"))


@query("svd_total_variance", with_views("kw") + " SELECT round(count(*)::DOUBLE, 4) AS total FROM kw")
def _(spark, sf):
    tf = materialise(M.tf(brands(spark, sf), "author_keywords"))
    return D.svd(tf, "id", "term", "tf", 25)["axes"].agg(F.round(F.sum("eigenvalue"), 4).alias("total"))


@query("lsa")
def _(spark, sf):
    return D.lsa(materialise(M.tfidf(M.tf(brands(spark, sf), "author_keywords"))), 3)["documents"]


@query("pca")
def _(spark, sf):
    return D.pca(materialise(M.tf(brands(spark, sf), "author_keywords")), "id", "term", "tf", 2)["rows"]


@query("mds")
def _(spark, sf):
    co = materialise(M.co_occurrence(brands(spark, sf), "author_keywords", 25))
    return D.mds(M.dissimilarity(M.normalize(co, "salton")))


@query("cluster_centers", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS axis FROM embeddings)
SELECT label AS cluster, CAST(axis AS INTEGER) AS axis, round(avg(v), 6) AS value FROM e GROUP BY ALL""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    coords = e.select(F.col("vec_id").alias("term"), F.posexplode("embedding").alias("axis", "value"))
    coords = coords.withColumn("value", F.col("value").cast("double"))
    return _round(D.cluster_centers(coords, e.select(F.col("vec_id").alias("term"), F.col("label").alias("cluster"))), "value")


# ------------------------------------------------------------------- clusters

def embedding_vectors(spark, sf):
    from pyspark.ml.functions import array_to_vector
    return table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("kmeans_clusters")
def _(spark, sf):
    return K.kmeans_clusters(embedding_vectors(spark, sf), 5, "vec_id")


@query("hierarchical_clusters")
def _(spark, sf):
    return K.hierarchical_clusters(embedding_vectors(spark, sf), 5, "vec_id")


@query("silhouette_sweep")
def _(spark, sf):
    return K.silhouette_sweep(embedding_vectors(spark, sf), [2, 3, 4])


def _density_sql(points: str, eps: float, least: int) -> str:
    """Density clusters by definition: points ``p(term, x)`` with a list of coordinates."""
    return f"""WITH RECURSIVE {points},
near AS MATERIALIZED (SELECT a.term AS a, b.term AS b FROM p a JOIN p b ON list_distance(a.x, b.x) <= {eps}),
core AS (SELECT a AS term FROM near GROUP BY a HAVING count(*) >= {least}),
l AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT term FROM core) AND b IN (SELECT term FROM core)),
rr AS (SELECT a, b FROM l UNION SELECT rr.a, l.b FROM rr JOIN l ON rr.b = l.a),
named AS (SELECT a AS term, min(b) AS name FROM rr GROUP BY a),
border AS (SELECT near.a AS term, min(name) AS name FROM near JOIN named ON named.term = near.b
           WHERE near.a NOT IN (SELECT term FROM core) GROUP BY 1)
SELECT term, CAST(name AS VARCHAR) AS cluster FROM p LEFT JOIN (FROM named UNION ALL FROM border) USING (term)"""


@query("density_clusters", _density_sql("p AS (SELECT s_suppkey AS term, [s_acctbal / 1000, CAST(s_nationkey AS DOUBLE)] AS x FROM supplier)", 1.0, 4))
def _(spark, sf):
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("term"), F.posexplode(
        F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double"))).alias("axis", "value"))
    return K.density_clusters(p, 1.0, 4)


@query("density_clusters_five_dimensions", _density_sql("""p AS (SELECT l_suppkey AS term, [round(avg(l_quantity), 6), round(avg(l_extendedprice) / 2000, 6),
 round(100 * avg(l_discount), 6), round(100 * avg(l_tax), 6), CAST(min(l_linenumber) AS DOUBLE)] AS x FROM lineitem GROUP BY l_suppkey)""", 1.2, 5))
def _(spark, sf):
    mean = lambda c, by=1.0: F.round(by * F.avg(c), 6)
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("term")).agg(F.array(
        mean("l_quantity"), F.round(F.avg("l_extendedprice") / 2000, 6), mean("l_discount", 100.0), mean("l_tax", 100.0),
        F.min("l_linenumber").cast("double")).alias("x"))
    return K.density_clusters(p.select("term", F.posexplode("x").alias("axis", "value")), 1.2, 5)


@query("affinity_clusters")
def _(spark, sf):
    c, edges = _equivalence(spark, sf)
    return K.affinity_clusters(materialise(edges.select("t1", "t2", "value")), 3)


@query("threshold_clusters", _co(k=25) + _normal("salton") + """, l AS (SELECT t1, t2 FROM v WHERE value >= 0.181),
x AS (SELECT term AS a, term AS b FROM top), rr AS (SELECT a, b FROM x UNION SELECT rr.a, l.t2 FROM rr JOIN l ON rr.b = l.t1)
SELECT a AS term, min(b) AS cluster FROM rr GROUP BY a""")
def _(spark, sf):
    co = M.co_occurrence(brands(spark, sf), "author_keywords", 25)
    return K.threshold_clusters(materialise(M.normalize(co, "salton")), 0.181)


SQL["threshold_clusters"] = SQL["threshold_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)


_FOREST = _co(k=40).replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT t1, t2, n, row_number() OVER (ORDER BY n DESC, t1, t2) AS r FROM co WHERE t1 < t2),
b AS (SELECT t1 AS x, t2 AS y, r FROM e UNION ALL SELECT t2, t1, r FROM e),
reach(r, node) AS (SELECT r, t1 FROM e UNION SELECT reach.r, b.y FROM reach JOIN b ON b.x = reach.node WHERE b.r < reach.r),
f AS (SELECT t1, t2, n FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = e.r AND reach.node = e.t2))"""


def _forest(spark, sf):
    co = materialise(M.co_occurrence(brands(spark, sf), "author_keywords", 40))
    return co, L.spanning_forest(co.select("t1", "t2", F.col("n").alias("value")))


@query("spanning_forest", _FOREST + " SELECT t1, t2, n AS value FROM f")
def _(spark, sf):
    return _forest(spark, sf)[1]


@query("linkage_profile", _FOREST + """ SELECT n AS value, count(*) AS merges,
(SELECT count(*) FROM top) - sum(count(*)) OVER (ORDER BY n DESC) AS clusters FROM f GROUP BY n""")
def _(spark, sf):
    co, forest = _forest(spark, sf)
    return L.linkage_profile(forest, co.select(F.col("t1").alias("node")))


@query("linkage_levels", _co(k=25).replace("WITH ", "WITH RECURSIVE ", 1) + _normal("salton") + """,
th AS (SELECT unnest([0.175, 0.181, 0.19])::DOUBLE AS th), l AS (SELECT th, t1, t2 FROM v, th WHERE value >= th),
rr(th, a, b) AS (SELECT th, term, term FROM top, th UNION SELECT rr.th, rr.a, l.t2 FROM rr JOIN l ON rr.b = l.t1 AND rr.th = l.th)
SELECT th AS threshold, a AS node, min(b) AS cluster FROM rr GROUP BY th, a""")
def _(spark, sf):
    edges = materialise(M.normalize(M.co_occurrence(brands(spark, sf), "author_keywords", 25), "salton"))
    forest = materialise(L.spanning_forest(edges))
    return L.linkage_levels(forest, edges.select(F.col("t1").alias("node")), [0.175, 0.181, 0.19])


@query("cluster_members", with_views("docs", "kw") + _TOP.format(rel="kw", k=12) + _CL + """
SELECT cluster, CAST(row_number() OVER w AS INTEGER) AS rank, term, d AS num_documents, first_value(term) OVER w AS name, count(*) OVER (PARTITION BY cluster) AS size
FROM top JOIN cl USING (term) WINDOW w AS (PARTITION BY cluster ORDER BY d DESC, c DESC, term)""")
def _(spark, sf):
    c = brands(spark, sf)
    return G.ordered_members(brand_clusters(c), T.kept_terms(c, "author_keywords", 12))


@query("cluster_documents", with_views("docs", "kw") + _TOP.format(rel="kw", k=12) + _CL + " SELECT DISTINCT cluster, id FROM kw JOIN cl USING (term)")
def _(spark, sf):
    c = brands(spark, sf)
    return K.cluster_documents(c, "author_keywords", brand_clusters(c))


@query("cited_sources", with_views("placed", "edges") + """
SELECT DISTINCT citing AS id, 'journal of ' || lower(o_orderpriority) AS term FROM edges JOIN orders ON cited = o_orderkey""")
def _(spark, sf):
    c = citation_edges(spark, sf).join(table(spark, sf, "orders"), F.col("cited") == F.col("o_orderkey")).groupBy(
        F.col("citing").alias("id")).agg(F.collect_set(F.concat(F.lit("Smith, J. (1999) Journal of "), "o_orderpriority", F.lit(", 12, no. 3, pp. 1-9"))).alias("global_references"))
    return K.cited_sources(c)


@query("cluster_by_cited_sources")
def _(spark, sf):
    sources = K.cited_sources(citation_edges(spark, sf).join(table(spark, sf, "orders"), F.col("cited") == F.col("o_orderkey")).groupBy(
        F.col("citing").alias("id")).agg(F.collect_set(F.concat(F.lit("Smith, J. (1999) Journal of "), "o_orderpriority", F.lit(", 12, no. 3, pp. 1-9"))).alias("global_references")))
    docs = sources.groupBy("id").agg(F.collect_set("term").alias("sources")).withColumn("global_citations", F.lit(0))
    return K.kmeans_clusters(K.document_vectors(materialise(docs), "sources", 50), 3, "id")


@query("cluster_text")
def _(spark, sf):
    return K.cluster_text(texts(spark, sf), "abstract", 4)


@query("thematic_analysis")
def _(spark, sf):
    return A.thematic_analysis(brands(spark, sf), "author_keywords", 4, 25)["keywords"]


@query("meaningful_contexts")
def _(spark, sf):
    d = texts(spark, sf)
    themes = A.thematic_analysis(d, "author_keywords", 3, 50, min_terms=1)
    return A.meaningful_contexts(d, themes["documents"], themes["keywords"]).select("cluster", "rank", "id", "context")


@query("conceptual_structure")
def _(spark, sf):
    return A.conceptual_structure(brands(spark, sf), "author_keywords", "mds", max_items=25)["members"]


@query("factor_map")
def _(spark, sf):
    return A.factor_map(brands(spark, sf), "author_keywords", "pca", "hierarchical", max_items=25)["coordinates"]


@query("comparative_analysis")
def _(spark, sf):
    return A.comparative_analysis(brands(spark, sf), "author_keywords", max_items=25)["clusters"]


@query("co_word_analysis")
def _(spark, sf):
    return A.co_word_analysis(brands(spark, sf), "author_keywords", max_items=25)["strategic_map"]
