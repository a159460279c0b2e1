"""Containment with tables of patterns: exact, and the texts are neither shuffled nor repeated."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import cleaning, text
from corpuscope.plans import containment


def _strings(rng, n, alphabet="aé 漢b", most=40):
    return ["".join(rng.choices(alphabet, k=rng.randrange(most))) for _ in range(n)]


def _refuse(*args, **kwargs):
    raise AssertionError("repeats each text for every shard of the patterns")


def test_contained_patterns_are_exact(spark):
    rng = random.Random(5)
    texts = list(enumerate(_strings(rng, 300))) + [(0, "ab" * 70), (1, None)]
    patterns = set(_strings(rng, 300, most=8)) | {"ab" * 33, "ab" * 64, "b", ""}
    a = spark.createDataFrame(texts, "id int, text string")
    b = spark.createDataFrame([(p,) for p in [*patterns, *patterns]] + [(None,)], "pattern string")
    got = [(r["id"], r["pattern"]) for r in containment.contained_patterns(a, b, ["id"]).distinct().collect()]
    assert set(got) == {(i, p) for i, t in texts for p in patterns if p and t and p in t}
    anywhere = [r["pattern"] for r in containment.contained_patterns(a, b).collect()]
    assert sorted(anywhere) == sorted({p for _, p in got})


@pytest.mark.parametrize("bits", [10, 30])
def test_a_full_filter_costs_work_but_no_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(containment, "MOST_BITS", bits)
    names = [(i, f"order number {i} of the year") for i in range(1000, 3000)]
    df = spark.createDataFrame(names, "id int, text string")
    got = containment.contained_patterns(df, df.select(F.col("text").alias("pattern")), ["id"])
    assert sorted((r["id"], r["pattern"]) for r in got.collect()) == names


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([("a b",)], "text string")
    found = containment.candidates(df, df.select(F.col("text").alias("pattern")), ["text"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_citations_do_not_repeat_the_references(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "containment_join", _refuse)
    refs = lambda i: [f"X. ORDER {i - 1}, {1990 + (i - 1) % 9}", f"Order {i + 1}, 1066"]
    docs = [(i, 1990 + i % 9, f"Order {i}", refs(i)) for i in range(100, 200)] + [(7, None, None, None), (8, 1066, "1066", ["no year"])]
    df = spark.createDataFrame(docs, "id int, year int, title string, global_references array<string>")
    got = {(r["citing"], r["cited"]) for r in cleaning.citation_pairs(df).collect()}
    assert got == {(i, i - 1) for i in range(101, 200)} | {(i, 8) for i in range(100, 200)}


def test_keywords_of_a_table_carry_ids_not_texts(spark, monkeypatch):
    monkeypatch.setattr(text, "containment_join", _refuse, raising=False)
    df = spark.createDataFrame([(1, "Red Boltß"), (1, "bolt red"), (2, None), (3, "rod")], "id int, t string")
    words = spark.createDataFrame([("RED",), ("red",), ("bolt",), ("boltß",), ("x",)], "term string")
    got = sorted((r["id"], r["term"]) for r in text.extract_keywords_from_table(df, "t", words).collect())
    assert got == [(1, "RED"), (1, "bolt"), (1, "boltß"), (1, "red")]
