"""Whole analyses, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import factor as D
from ..operators import matrix as M
from ..operators.filters import min_terms_per_doc
from ..operators.graph import ordered_members
from ..operators.terms import kept_terms
from .lineage import materialise


def _kept_tf(df: DataFrame, col: str, max_items: int, min_occ: int) -> DataFrame:
    axis = kept_terms(df, col, max_items, "num_documents", min_occ)
    lists = M.kept_lists(df, col, axis)
    return lists.select("id", F.explode("terms").alias("term"), F.lit(1.0).alias("tf"))


def thematic_analysis(
    df: DataFrame, col: str, n_clusters: int = 6, max_items: int = 50, min_occ: int = 1, min_terms: int = 2, top: int = 10
) -> dict[str, DataFrame]:
    """Themes of a corpus: documents clustered by their l2 TF-IDF rows.

    Returns ``documents`` (id, cluster), ``contingency`` (cluster, term, value),
    ``keywords`` (the ``top`` terms per theme), ``sizes`` and ``map`` (themes and
    terms on the axes of a correspondence analysis).
    """
    vecs = K.document_vectors(df, col, max_items, min_occ, use_idf=True, norm=2.0, min_terms=min_terms)
    documents = materialise(K.kmeans_clusters(vecs, n_clusters, "id"))
    binary = min_terms_per_doc(_kept_tf(df, col, max_items, min_occ), min_terms)
    table = materialise(M.contingency(binary, documents))
    # At most MAX_AXIS terms per theme.
    order = Window.partitionBy("cluster").orderBy(F.col("value").desc(), "term")
    keywords = table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ca = D.correspondence_analysis(table, "cluster", "term", "value")
    return {
        "documents": documents,
        "contingency": table,
        "keywords": keywords,
        "sizes": documents.groupBy("cluster").agg(F.count(F.lit(1)).alias("num_documents")),
        "map": ca["rows"].select(F.col("cluster").alias("item"), "axis", "principal", F.lit("theme").alias("kind")).unionByName(
            ca["cols"].select(F.col("term").alias("item"), "axis", "principal", F.lit("term").alias("kind"))
        ),
    }


def meaningful_contexts(
    df: DataFrame, documents: DataFrame, keywords: DataFrame, text: str = "abstract", th: DataFrame | None = None, top: int = 10
) -> DataFrame:
    """The ``top`` most cited documents per theme, with the keywords of the theme in capitals.

    ``keywords`` is ``(cluster, term)``, a short list per theme; ``th`` adds the
    variants of each keyword.
    """
    order = Window.partitionBy("cluster").orderBy(F.col("global_citations").desc(), "id")
    # Ranked without their texts; all rows of the best ids are fetched and ranked again.
    narrow = df.select("id", "global_citations").join(documents, "id")
    ids = materialise(narrow.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("id").distinct())
    best = df.join(F.broadcast(ids), "id", "left_semi").join(documents, "id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = keywords.select("cluster", "term")
    if th is not None:
        words = words.union(words.join(th.toDF("term", "variant"), "term").select("cluster", "variant")).distinct()
    lists = words.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("k"), "term"))), lambda s: s["term"]).alias("_words")
    )
    marked = F.aggregate(
        "_words",
        F.col(text),
        lambda acc, w: F.regexp_replace(acc, F.concat(F.lit("(?iu)\\Q"), w, F.lit("\\E")), F.upper(w)),
    )
    return best.join(lists, "cluster").withColumn("context", marked).drop("_words")


def _coordinates(edges: DataFrame, method: str, k: int) -> DataFrame:
    """Coordinates ``(term, axis, value)`` of the terms of a full association matrix."""
    if method == "mds":
        return D.mds(M.dissimilarity(edges), k)
    if method == "pca":
        rows = D.pca(M.dissimilarity(edges), "t1", "t2", "value", k)["rows"]
        return rows.select(F.col("t1").alias("term"), "axis", "value")
    if method == "svd":
        parts = D.svd(M.dissimilarity(edges), "t1", "t2", "value", k)
        rows = parts["rows"].join(F.broadcast(parts["axes"]), "axis")
        return rows.select(F.col("t1").alias("term"), "axis", (F.col("value") * F.col("singular_value")).alias("value"))
    if method == "ca":
        rows = D.correspondence_analysis(edges, "t1", "t2", "value", k)["rows"]
        return rows.select(F.col("t1").alias("term"), "axis", F.col("principal").alias("value"))
    raise ValueError(f"unknown map method {method!r}")


def _cluster(coords: DataFrame, method: str, n_clusters: int) -> DataFrame:
    vecs = K.vectors(coords)
    if method == "kmeans":
        return K.kmeans_clusters(vecs, n_clusters)
    if method == "hierarchical":
        return K.hierarchical_clusters(vecs, n_clusters)
    if method == "density":
        return K.density_clusters(coords)
    raise ValueError(f"unknown clustering {method!r}")


def conceptual_structure(
    df: DataFrame,
    col: str,
    method: str = "mds",
    clustering: str = "kmeans",
    n_clusters: int = 4,
    association: str | None = "salton",
    max_items: int = 50,
    min_occ: int = 1,
    dims: int = 2,
) -> dict[str, DataFrame]:
    """Keywords map: association matrix, coordinates by ``method``, clusters and their members."""
    co = materialise(M.co_occurrence(df, col, max_items, min_occ=min_occ))
    edges = M.normalize(co, association, df.agg(F.count(F.lit(1))).scalar())
    coords = materialise(_coordinates(edges, method, dims))
    clusters = materialise(_cluster(coords, clustering, n_clusters))
    counters = kept_terms(df, col, max_items, "num_documents", min_occ)
    return {
        "edges": edges,
        "coordinates": coords,
        "clusters": clusters,
        "members": ordered_members(clusters, counters),
        "centers": D.cluster_centers(coords, clusters),
        "documents": K.cluster_documents(df, col, clusters),
    }


factor_map = conceptual_structure


def comparative_analysis(
    df: DataFrame, col: str, n_clusters: int = 4, on: str = "terms", max_items: int = 50, min_occ: int = 1, dims: int = 10
) -> dict[str, DataFrame]:
    """Correspondence analysis of idf-weighted occurrences; terms or documents clustered on its axes."""
    weights = M.tfidf(_kept_tf(df, col, max_items, min_occ), norm=None, max_items=max_items)
    ca = D.correspondence_analysis(materialise(weights), "id", "term", "tfidf", dims)
    side, item = ("cols", "term") if on == "terms" else ("rows", "id")
    coords = materialise(ca[side].select(item, "axis", F.col("principal").alias("value")))
    clusters = K.kmeans_clusters(K.vectors(coords, item), n_clusters, item)
    return {"axes": ca["axes"], "coordinates": coords, "clusters": clusters}


def co_word_analysis(
    df: DataFrame,
    col: str,
    n_clusters: int = 4,
    association: str | None = "equivalence",
    clustering: str = "hierarchical",
    max_items: int = 50,
    min_occ: int = 1,
) -> dict[str, DataFrame]:
    """Co-word analysis and concept mapping.

    Terms are clustered on their dissimilarities; returns ``members``, the
    ``strategic_map`` of clusters, the cluster ``network``, and maps of terms by
    classical scaling (``mds``) and correspondence analysis (``ca``) with centers.
    """
    co = materialise(M.co_occurrence(df, col, max_items, min_occ=min_occ))
    edges = materialise(M.normalize(co, association, df.agg(F.count(F.lit(1))).scalar()))
    apart = materialise(M.dissimilarity(edges))
    vecs = K.edge_vectors(apart)
    find = K.hierarchical_clusters if clustering == "hierarchical" else K.kmeans_clusters
    clusters = materialise(find(vecs, n_clusters))
    mds = D.mds(apart)
    ca = D.correspondence_analysis(edges, "t1", "t2", "value")["rows"].select(
        F.col("t1").alias("term"), "axis", F.col("principal").alias("value")
    )
    counters = kept_terms(df, col, max_items, "num_documents", min_occ)
    return {
        "clusters": clusters,
        "members": ordered_members(clusters, counters),
        "network": M.cluster_co_occurrence(edges, clusters),
        "strategic_map": M.strategic_map(edges, clusters),
        "mds": mds,
        "mds_centers": D.cluster_centers(mds, clusters),
        "ca": ca,
        "ca_centers": D.cluster_centers(ca, clusters),
    }


concept_mapping = co_word_analysis
