"""The plan building blocks against brute force, with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.plans import skew
from corpuscope.plans.containment import containment_join
from corpuscope.plans.running import ordinal, running


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 5)
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(i, None) for i in range(300, 400)]
    left = spark.createDataFrame(rows, "id int, k string").repartition(4)
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3), ("zz", 4), (None, 5)], "k string, v int")
    assert skew.hot_keys(left, ["k"]) is not None
    got = sorted(map(repr, skew.skew_join(left, right, "k", how, hot="detect").collect()))
    assert got == sorted(map(repr, left.join(right, "k", how).collect()))


def test_hot_keys_are_few_and_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 5)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    hot = skew.hot_keys(left, ["k"]).collect()
    assert [(r["k"], r["_salts"]) for r in hot] == [("hot", 67)]


def test_running_matches_python(spark):
    rng = random.Random(1)
    rows = [(("g" if rng.random() < 0.7 else f"h{rng.randrange(5)}"), i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {r["i"]: r["s"] for r in running(df, ["g"], [F.col("i").desc()], sums={"s": F.col("v")}).collect()}
    totals = {}
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        totals[g] = totals.get(g, 0) + v
        assert got[i] == totals[g]


def test_ordinal_without_group(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    assert all(r["k"] == r["x"] + 1 for r in ordinal(df, [], [F.col("x")], "k").collect())


def test_containment_is_exact(spark):
    rng = random.Random(2)
    words = ["ab", "b", "abc", "ca", "", "a-b", "xyzabcxyzab"]
    texts = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(120)} - {""}
    patterns = set()
    for t in texts:
        i = rng.randrange(len(t))
        patterns.add(t[i : i + rng.randrange(1, 14)])
    patterns -= {""}
    a = spark.createDataFrame([(t,) for t in texts], "text string")
    b = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = [(r["text"], r["pattern"]) for r in containment_join(a, b).collect()]
    want = {(t, p) for t in texts for p in patterns if p in t}
    assert len(got) == len(set(got)) and set(got) == want
