"""Clustering of documents, terms and factor coordinates with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, Normalizer
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.items import doc_terms, items
from ..plans.lineage import materialise, spread
from ..plans.running import ordinal
from ..plans.skew import skew_join
from ..plans.spatial import near_boxes
from .graph import connected_components
from .terms import check_axis, kept_terms


def vectors(coords: DataFrame, item: str = "term") -> DataFrame:
    """``(item, features)`` from ``(item, axis, value)``."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("axis", "value"))), lambda s: s["value"])
    return coords.groupBy(item).agg(array_to_vector(packed).alias("features"))


def edge_vectors(edges: DataFrame) -> DataFrame:
    """``(term, features)``: rows of a full ``(t1, t2, value)`` matrix of bounded size."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("t2", "value"))), lambda s: s["value"])
    return edges.groupBy(F.col("t1").alias("term")).agg(array_to_vector(packed).alias("features"))


def document_vectors(
    df: DataFrame,
    col: str,
    max_items: int = 50,
    min_occ: int = 1,
    use_idf: bool = False,
    norm: float | None = None,
    min_terms: int = 1,
) -> DataFrame:
    """``(id, features)``: sparse rows of the document-term matrix, built in the JVM.

    ``use_idf`` weighs columns by ``ln((1+n)/(1+df)) + 1``; ``norm`` is the p of a
    row norm; documents with fewer than ``min_terms`` kept terms are left out.
    """
    axis = kept_terms(df, col, max_items, "num_documents", min_occ)
    names = [r["term"] for r in axis.select("term").collect()]
    kept = F.array_intersect(items(df, col), F.array(*[F.lit(n) for n in names]))
    # A few terms a document, read several times; kept as they lie for the centres of k-means.
    lists = df.select("id", kept.alias("_terms")).persist().where(F.size("_terms") >= min_terms)
    counter = CountVectorizerModel.from_vocabulary(names, "_terms", "features" if not use_idf else "_tf")
    table = counter.transform(lists)
    if use_idf:
        freq = lists.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        counts = {r["term"]: r["n"] for r in freq.collect()}  # one number per kept term
        n = lists.count()
        import math

        idf = [math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in names]
        table = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="features").transform(table)
    if norm is not None:
        table = Normalizer(p=norm, inputCol="features", outputCol="_n").transform(table)
        return table.select("id", F.col("_n").alias("features"))
    return table.select("id", "features")


def _named(predictions: DataFrame, item: str) -> DataFrame:
    return predictions.select(item, F.format_string("CL_%02d", F.col("prediction")).alias("cluster"))


def kmeans_clusters(vecs: DataFrame, k: int, item: str = "term", seed: int = 42) -> DataFrame:
    """``(item, cluster)`` by k-means."""
    return _named(KMeans(k=k, seed=seed).fit(vecs).transform(vecs), item)


def hierarchical_clusters(vecs: DataFrame, k: int, item: str = "term", seed: int = 42) -> DataFrame:
    """``(item, cluster)`` by divisive bisecting k-means."""
    return _named(BisectingKMeans(k=k, seed=seed).fit(vecs).transform(vecs), item)


def affinity_clusters(edges: DataFrame, k: int, max_iter: int = 10) -> DataFrame:
    """``(term, cluster)`` by power iteration on ``(t1, t2, value)`` similarities."""
    links = edges.where("t1 < t2 AND value > 0")
    names = links.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    numbered = ordinal(names.withColumn("_all", F.lit(0)), ["_all"], [F.col("term")], "id")
    numbered = materialise(numbered.select("term", "id"))
    graph = links.join(numbered.toDF("t1", "src"), "t1").join(numbered.toDF("t2", "dst"), "t2").select(
        "src", "dst", F.col("value").alias("weight")
    )
    model = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="weight")
    found = model.assignClusters(graph).join(numbered, "id")
    return found.select("term", F.format_string("CL_%02d", F.col("cluster")).alias("cluster"))


def threshold_clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """``(term, cluster)``: single linkage, components of the links at or above the threshold."""
    loops = edges.select(F.col("t1"), F.col("t1").alias("t2"))
    links = edges.where(F.col("value") >= threshold).select("t1", "t2").union(loops)
    return connected_components(links).withColumnRenamed("node", "term")


#: Comparisons of points made at once; where boxes leave more of them open, the boxes are cut.
COMPARED = 5_000_000
#: Cells are halved so often at most, which keeps the numbers of the parts below 2^61.
HALVINGS = 30


def _squared(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v * v)


def _minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def _outside(low: str, high: str, lo: str, hi: str) -> Column:
    """Squared distance between the boxes from ``low`` to ``high`` and from ``lo`` to ``hi``."""
    return _squared(F.zip_with(_minus(lo, high), _minus(low, hi), lambda u, v: F.greatest(u, v, F.lit(0.0))))


def _near(a: str, b: str, eps: float) -> Column:
    return _squared(_minus(a, b)) <= eps * eps + 1e-12


def _boxes(points: DataFrame, dims: int, *keys: str) -> DataFrame:
    """``(*keys, lo, hi, n)``: corners and number of the points ``x`` of each key."""
    corners = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(*keys).agg(*corners, F.count(F.lit(1)).alias("n")).select(
        *keys, *[F.array(*[f"{n}{i}" for i in range(dims)]).alias(n) for n in ("lo", "hi")], "n"
    )


def _facing(pairs: DataFrame, boxes: DataFrame, key: str, eps: float) -> DataFrame:
    """The ``pairs`` (a, b) of boxes within reach, with corners, numbers and ``sure``.

    A pair is sure when all points of one box are near all of the other, so boxes of one
    point each are always decided.
    """
    for end in ("a", "b"):
        pairs = pairs.join(boxes.select(F.col(key).alias(end), *[F.col(c).alias(f"{end}{c}") for c in ("lo", "hi", "n")]), end)
    gap = _outside("blo", "bhi", "alo", "ahi")
    span = _squared(F.zip_with(_minus("bhi", "alo"), _minus("ahi", "blo"), lambda u, v: F.greatest(F.abs(u), F.abs(v))))
    single = (F.col("alo") == F.col("ahi")) & (F.col("blo") == F.col("bhi"))
    return pairs.where(gap <= eps * eps + 1e-12).withColumn("sure", single | (span <= eps * eps))


def _open_comparisons(pairs: DataFrame) -> float:
    return pairs.agg(F.sum(F.col("an").cast("double") * F.col("bn"))).first()[0] or 0.0


def _cells_that_meet(points: DataFrame, pairs: DataFrame, dims: int, eps: float, side: float) -> DataFrame:
    """``(a_cell, b_cell)``: the ``pairs`` of cells that hold ``points`` at most ``eps`` apart.

    While too many points would be compared, the cells are cut into parts of half the
    side, whose boxes settle most of it: a pair of cells is done with its first sure pair
    of parts, and parts beyond reach of each other are left out.
    """
    found = []
    points = points.withColumnRenamed("cell", "part")
    pairs = pairs.drop("sure").withColumns({"a_cell": F.col("a"), "b_cell": F.col("b")})
    for level in range(1, HALVINGS + 1):
        if _open_comparisons(pairs) <= COMPARED:
            break
        cut = F.transform("x", lambda v: F.floor(v / (side / 2**level)))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("part")).distinct()
        points = points.join(ends, "part", "left_semi").select(F.col("part").alias("of"), "x", cut.alias("part"))
        points = materialise(points)
        boxes = materialise(_boxes(points, dims, "of", "part"))
        points = points.select("x", "part")
        pairs = pairs.select("a_cell", "b_cell", "a", "b")
        for end in ("a", "b"):
            parts = boxes.select(F.col("of").alias(end), F.col("part").alias("_part"))
            pairs = skew_join(pairs, parts, end).drop(end).withColumnRenamed("_part", end)
        pairs = materialise(_facing(pairs, boxes, "part", eps))
        found.append(materialise(pairs.where("sure").select("a_cell", "b_cell").distinct()))
        pairs = pairs.where(~F.col("sure")).join(found[-1], ["a_cell", "b_cell"], "left_anti").drop("sure")
        pairs = materialise(pairs)
    # Boxes leave the rest open: compare only the points of each part within reach of the other box.
    reach = eps * eps + 1e-12
    left = points.withColumnRenamed("part", "a").join(pairs, "a").where(_outside("x", "x", "blo", "bhi") <= reach)
    right = points.withColumnRenamed("part", "b").join(pairs, "b").where(_outside("x", "x", "alo", "ahi") <= reach)
    left = left.select("a_cell", "b_cell", "a", "b", F.col("x").alias("ax"))
    right = right.select("a", "b", F.col("x").alias("bx"))
    met = skew_join(left, right, ["a", "b"]).where(_near("ax", "bx", eps)).select("a_cell", "b_cell").distinct()
    for some in found:
        met = met.union(some)
    return materialise(met)


def density_clusters(
    coords: DataFrame, eps: float = 0.5, min_samples: int = 5, item: str = "term"
) -> DataFrame:
    """``(item, cluster)``: density clustering of points ``(item, axis, value)``.

    Equal points are one weighted point.  Space is cut into cells whose diagonal
    is ``eps``: points of one cell are neighbours, so a cell with ``min_samples``
    points is all core and is one node, and only cells with fewer points are
    compared point by point with their surroundings.  The occupied cells within reach
    of each other come from a tree over their boxes, whatever the number of dimensions.
    Two dense cells whose boxes leave open if they are near are cut into smaller boxes
    where they hold many points, and not at all where other cells link them already.
    A cluster is named by its smallest core item; a border point takes the smallest name
    among those of the cores it can see.  Noise has a NULL cluster.
    """
    points = coords.groupBy(item).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("axis", "value"))), lambda s: s["value"]).alias("x")
    )
    dims = points.select(F.max(F.size("x"))).first()[0]
    if dims is None:
        return points.select(item, F.lit(None).cast("string").alias("cluster"))
    side = eps / dims**0.5
    cell = F.transform("x", lambda v: F.floor(v / side).cast("int"))
    points = materialise(points.withColumn("cell", cell))
    distinct = points.groupBy("x", "cell").agg(F.count(F.lit(1)).alias("w")).withColumn(
        "pid", F.array_join(F.transform("x", lambda v: v.cast("string")), " ")
    )
    distinct = materialise(distinct)
    totals = distinct.groupBy("cell").agg(F.sum("w").alias("n"))
    dense = totals.where(F.col("n") >= min_samples).select("cell")
    sparse = distinct.join(totals.where(F.col("n") < min_samples).select("cell"), "cell", "left_semi")
    boxes = materialise(_boxes(distinct, dims, "cell"))
    beside = materialise(near_boxes(boxes.withColumnRenamed("cell", "box"), eps))

    probes = sparse.select(F.col("pid").alias("probe"), F.col("x").alias("px"), F.col("cell").alias("a"))
    probes = skew_join(probes, beside, "a").select("probe", "px", F.col("b").alias("cell"))
    # A dense cell that is near as a whole counts as such; the points of others are compared.
    around = skew_join(probes, boxes.drop("n").join(totals, "cell"), "cell").where(
        _outside("px", "px", "lo", "hi") <= eps * eps + 1e-12
    )
    corner = F.zip_with(_minus("hi", "px"), _minus("px", "lo"), lambda u, v: F.greatest(F.abs(u), F.abs(v)))
    all_near = (F.col("n") >= min_samples) & (_squared(corner) <= eps * eps)
    around = materialise(around.select("probe", "px", "cell", "n", all_near.alias("whole")))
    whole = around.where("whole").select("probe", "cell", "n")
    probes = around.where("NOT whole").select("probe", "px", "cell")
    close = materialise(
        skew_join(spread(distinct, "pid"), probes, "cell").where(_near("x", "px", eps)).select("probe", "pid", "w")
    )
    seen_points = close.select("probe", F.col("w").alias("n")).union(whole.select("probe", "n"))
    core_probes = seen_points.groupBy("probe").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("probe")
    cell_node = F.concat(F.lit("cell "), F.array_join("cell", " "))
    node_of = distinct.join(dense, "cell", "left_semi").select("pid", cell_node.alias("node")).union(
        core_probes.select(F.col("probe").alias("pid"), F.concat(F.lit("point "), "probe"))
    )
    node_of = materialise(node_of)
    # Links: sparse cores to cores they can see, and dense cells to dense cells.
    seen = skew_join(close.join(core_probes, "probe", "left_semi"), node_of, "pid").select(
        F.concat(F.lit("point "), "probe").alias("t1"), F.col("node").alias("t2")
    )
    seen = seen.union(whole.select(F.concat(F.lit("point "), "probe"), cell_node))
    dense_points = distinct.join(dense, "cell", "left_semi").select("x", "cell")
    dense_boxes = boxes.join(dense, "cell", "left_semi")
    pairs = beside.where(F.array_join("a", " ") < F.array_join("b", " "))
    pairs = materialise(_facing(pairs, dense_boxes, "cell", eps))
    name = lambda c: F.concat(F.lit("cell "), F.array_join(c, " "))
    own = node_of.select(F.col("node").alias("t1"), F.col("node").alias("t2")).distinct()
    links = seen.union(pairs.where("sure").select(name("a"), name("b"))).union(own)
    unsure = pairs.where(~F.col("sure"))
    if _open_comparisons(unsure) > COMPARED:
        # Cells that are linked by a way that is known need no link of their own.
        links = materialise(links)
        known = materialise(connected_components(links))
        for end in ("a", "b"):
            home = known.select(F.col("node").alias("_node"), F.col("cluster").alias(f"_{end}"))
            unsure = unsure.withColumn("_node", name(end)).join(home, "_node").drop("_node")
        unsure = materialise(unsure.where("_a <> _b").drop("_a", "_b"))
    met = _cells_that_meet(dense_points, unsure, dims, eps, side)
    comps = materialise(connected_components(links.union(met.select(name("a_cell"), name("b_cell")))))
    keyed = points.withColumn("pid", F.array_join(F.transform("x", lambda v: v.cast("string")), " "))
    cores = materialise(node_of.join(comps, "node").select("pid", "cluster"))
    names = skew_join(keyed, cores, "pid").groupBy("cluster").agg(F.min(item).alias("name"))
    cores = skew_join(cores, names, "cluster").select("pid", "name")
    border = (
        skew_join(close.join(core_probes, "probe", "left_anti"), cores, "pid")
        .groupBy(F.col("probe").alias("pid"))
        .agg(F.min("name").alias("name"))
    )
    labelled = cores.union(border)
    return skew_join(keyed, labelled, "pid", "left").select(item, F.col("name").cast("string").alias("cluster"))


def cluster_documents(df: DataFrame, col: str, clusters: DataFrame) -> DataFrame:
    """``(cluster, id)``: documents holding any term of each cluster."""
    return skew_join(doc_terms(df, col), clusters.select("term", "cluster"), "term").select("cluster", "id").distinct()


def silhouette_sweep(vecs: DataFrame, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """``(k, silhouette)`` for k-means with each k."""
    spark = vecs.sparkSession
    vecs = materialise(vecs)
    score = ClusteringEvaluator()
    rows = [(k, float(score.evaluate(KMeans(k=k, seed=seed).fit(vecs).transform(vecs)))) for k in ks]
    return spark.createDataFrame(rows, "k int, silhouette double")


def cited_sources(df: DataFrame, col: str = "global_references") -> DataFrame:
    """``(id, term)``: the journals named in the references of each document.

    A reference reads ``... (year) journal, volume, ... pp. ...``; the journal is
    what follows the year in parentheses, up to the next comma.
    """
    source = F.trim(F.regexp_extract(F.lower("term"), r"\(\d{4}\)\s*([^,]+),.* pp\. ", 1))
    return doc_terms(df, col).select("id", source.alias("term")).where("term <> ''").distinct()


def cluster_text(
    df: DataFrame, col: str, k: int, max_items: int = 1000, min_occ: int = 2, seed: int = 42
) -> DataFrame:
    """``(id, cluster)``: k-means on the bag of words of a text column."""
    words = RegexTokenizer(inputCol=col, outputCol="_w", pattern=r"[^\p{L}]+").transform(df.where(F.col(col).isNotNull()))
    clean = StopWordsRemover(inputCol="_w", outputCol="_c").transform(words).select("id", "_c")
    counts = CountVectorizer(inputCol="_c", outputCol="_tf", vocabSize=check_axis(max_items), minDF=min_occ).fit(clean).transform(clean)
    # The texts are cut into words once for the vocabulary and once for the counts.  Kept
    # as they lie, because the first centres depend on the layout.
    counts = counts.select("id", "_tf").persist()
    weighted = IDF(inputCol="_tf", outputCol="_x").fit(counts).transform(counts)
    vecs = Normalizer(inputCol="_x", outputCol="features").transform(weighted).select("id", "features")
    return kmeans_clusters(vecs, k, "id", seed)


