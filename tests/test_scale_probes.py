"""Cases that only show at scale, on small inputs."""

import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import graph, text
from corpuscope.operators.cleaning import citation_pairs
from corpuscope.operators.matrix import bigraph, tfidf, tfidf_ranking, tf
from corpuscope.plans import containment
from corpuscope.plans.containment import containment_join
from corpuscope.plans.lineage import materialise


@pytest.mark.parametrize(
    "name", ["alpha{} of beta{}", "alpha{} one of the beta{}", "alpha{} of internationalisation{}", "the the the {} {}"]
)
def test_containment_with_common_words_gives_matches_only(spark, name):
    names = [(name.format(i, i),) for i in range(1000, 4000)]
    texts = spark.createDataFrame(names, "text string")
    patterns = spark.createDataFrame(names, "pattern string")
    rows = []
    scan = containment._scan

    def counted(batches):
        for batch in scan(batches):
            rows.extend(batch.column("patterns").to_pylist())
            yield batch

    parts = [(0, False, n) for (n,) in names] + [(0, True, n) for (n,) in names]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts)], names=["_part", "_text", "value"])
    list(counted(iter([batch])))
    assert rows == [[n] for (n,) in names]
    start = time.time()
    assert containment_join(texts, patterns).count() == 3000
    assert time.time() - start < 30


def test_containment_over_shards_and_buckets(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choices("abc ", k=rng.randrange(1, 60))) for _ in range(300)}
    patterns = {"".join(rng.choices("abc ", k=rng.randrange(1, 7))) for _ in range(200)} | {"", "abc" * 30}
    a = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    b = spark.createDataFrame([(p,) for p in patterns] + [(None,)], "pattern string")
    got = [(r["text"], r["pattern"]) for r in containment_join(a, b, shard_chars=50, bucket_chars=500).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(t, p) for t in texts for p in patterns if p and p in t}
    assert containment_join(a, b.limit(0)).count() == containment_join(a.limit(0), b).count() == 0


def test_citations_of_a_common_title_meet_by_year(spark):
    docs = [(i, 1900 + i % 100, "editorial", [f"X, Editorial, {1900 + (i + 1) % 100}"] if i < 3 else None) for i in range(2000)]
    df = spark.createDataFrame(docs, "id int, year int, title string, global_references array<string>")
    got = {(r["citing"], r["cited"]) for r in citation_pairs(df).collect()}
    assert got == {(i, j) for i in range(3) for j in range(2000) if j % 100 == i + 1}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "t1 int, t2 int")
    assert graph.connected_components(edges).select("cluster").distinct().count() == 1


def test_axes_by_totals_see_more_than_3000_terms(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        rows.append((i, [f"a{rng.randrange(6000)}" for _ in range(5)], [f"b{rng.randrange(6000)}" for _ in range(rng.randrange(1, 9))]))
    # A rare term in a document with many partners has the largest total.
    rows.append((900, ["rare"], [f"b{j}" for j in range(700)]))
    df = spark.createDataFrame(rows, "id int, x array<string>, y array<string>").withColumn("global_citations", F.lit(1)).withColumn("local_citations", F.lit(1))
    got = {(r["term"], r["by"]): r["n"] for r in bigraph(df, "x", "y", 10, 10, top_data=True).collect()}
    cells = Counter((a, b) for _, x, y in rows for a in set(x) for b in set(y))
    totals = Counter()
    for (a, _), n in cells.items():
        totals[a] += n
    keep = sorted(totals, key=lambda t: (-totals[t], t))[:10]
    columns = Counter()
    for (a, b), n in cells.items():
        if a in keep:
            columns[b] += n
    kept = sorted(columns, key=lambda t: (-columns[t], t))[:10]
    assert "rare" in keep
    assert got == {(a, b): n for (a, b), n in cells.items() if a in keep and b in kept}


def test_tfidf_keeps_all_terms(spark):
    df = spark.createDataFrame([(i, [f"t{i}", "every"]) for i in range(3500)], "id int, x array<string>")
    weights = materialise(tfidf(tf(df, "x")))
    assert weights.select("term").distinct().count() == 3501
    assert tfidf_ranking(weights, 3501).count() == 3501


def test_keywords_keep_their_form_and_case(spark):
    df = spark.createDataFrame(
        [(1, "We do R&D in c++ with Deep Learning. A neural net.", ["R&D", "C++", "Deep Learning"], ["Neural Net", "net"])],
        "id int, abstract string, author_keywords array<string>, index_keywords array<string>",
    )
    row = text.keywords_in_abstract(df).first()
    assert row["abstract_author_keywords"] == ["C++", "Deep Learning", "R&D"]
    assert row["abstract_index_keywords"] == ["Neural Net"]
    assert {r[0] for r in text.co_mentioned(df, "author_keywords", "deep learning").collect()} == {"R&D", "C++", "Deep Learning"}
    assert {r[0] for r in text.mentioned_keywords(df, "index_keywords").collect()} == {"Neural Net", "net"}


def test_keywords_of_a_long_text_are_found_in_linear_time(spark):
    words = [f"w{i}" for i in range(16_000)]
    df = spark.createDataFrame([(1, " ".join(words), words, [])], "id int, abstract string, author_keywords array<string>, index_keywords array<string>")
    start = time.time()
    assert len(text.keywords_in_abstract(df).first()["abstract_keywords"]) == 16_000
    assert time.time() - start < 30


def test_path_counts_beyond_38_digits(spark):
    layers, width = 40, 12
    edges = [(l * 100 + i, l * 100 + 100 + j) for l in range(layers) for i in range(width) for j in range(width)]
    df = spark.createDataFrame(edges, "src int, dst int")
    counts = graph.path_counts(df, approximate=True).collect()
    assert all(r["count"] is None and abs(r["approx"] / 12.0 ** (layers - 1) - 1) < 1e-9 for r in counts)
    few = graph.path_counts(df.where("src < 1000")).collect()
    assert {int(r["count"]) for r in few} == {12**9}


def test_main_path_beyond_38_digits(spark):
    layers, width = 18, 160
    edges = [(0, 1), (1, 2)]
    edges += [(2 if l == 0 else l * 1000 + i, (l + 1) * 1000 + j) for l in range(layers) for i in range(1 if l == 0 else width) for j in range(width)]
    df = spark.createDataFrame(edges[:2] + random.Random(1).sample(edges[2:], len(edges) - 2), "src int, dst int")
    kept = graph.main_path(df)
    assert {(r["src"], r["dst"]) for r in kept.where("dst < 3").collect()} == {(0, 1), (1, 2)}


def test_label_propagation_ends_and_splits_cliques(spark):
    edges = [(i, j) for c in (0, 10) for i in range(c, c + 6) for j in range(i + 1, c + 6)] + [(20, 21)]
    df = spark.createDataFrame(edges, "t1 int, t2 int").withColumn("value", F.lit(1.0))
    for found in (graph.label_propagation(df), graph.louvain(df)):
        groups = {}
        for r in found.collect():
            groups.setdefault(r["cluster"], set()).add(r["node"])
        assert sorted(map(sorted, groups.values())) == [list(range(6)), list(range(10, 16)), [20, 21]]


@pytest.mark.parametrize("top_data", [True, False])
def test_bigraph_makes_its_columns_once(spark, top_data):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = [(i, 1, ["a", "b"][: 1 + i % 2], ["x"]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, global_citations int, x array<string>, y array<string>")
    df = df.mapInPandas(seen, df.schema)
    got = {(r["term"], r["by"]): r["n"] for r in bigraph(df, "x", "y", 10, 10, top_data=top_data).collect()}
    assert got == {("a", "x"): 20, ("b", "x"): 10}
    assert made.value == 20
