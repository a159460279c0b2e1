"""Texts of many words: keywords and spellings travel once a text."""

import time

from pyspark.sql import functions as F

from corpuscope.operators import text


def test_a_keyword_travels_once_a_text(spark):
    df = spark.createDataFrame([(1, ["a", "b"] * 50), (1, ["a"]), (2, None)], "id int, t array<string>")
    got = sorted((r["id"], r["gram"]) for r in text._token_grams(df, "t", [1, 2]).collect())
    assert got == [(1, "a"), (1, "a"), (1, "a b"), (1, "b"), (1, "b a")]


def test_longer_keywords_claim_words_of_a_long_text(spark):
    words = [f"w{i}" for i in range(3000)]
    body = " ".join(words) + " neural net w1 net"
    rows = [(1, body, ["Neural Net", "net", *words], ["w1 NET"]), (1, body, None, None), (2, "net!", None, ["!"]), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, abstract string, author_keywords array<string>, index_keywords array<string>")
    got = text.keywords_in_abstract(df).collect()
    assert len(got) == 4
    for r in got:
        if r["id"] == 1:
            assert r["abstract_keywords"] == sorted(["Neural Net", "w1 NET", *words])
            assert r["abstract_index_keywords"] == ["w1 NET"]
        elif r["id"] == 2:
            assert (r["abstract_author_keywords"], r["abstract_index_keywords"]) == (["net"], ["!"])
        else:
            assert r["abstract_keywords"] is None


def test_spelling_of_long_texts_in_linear_time(spark):
    n = 20_000
    body = "_".join(["x"]) + " " + ", ".join(f"b{i}" for i in range(n))
    df = spark.createDataFrame([(i % 30, body, None) for i in range(30)] + [(99, None, "b1 b́ b2")], "id int, t string, u string")
    pairs = spark.createDataFrame([(f"b{i}", f"a{i}" if i else None) for i in range(n)] + [("zz", "y")], "british string, american string")
    start = time.time()
    got = {r["id"]: r for r in text.to_american(df, ["t", "u"], pairs).collect()}
    assert time.time() - start < 45
    assert got[7]["t"] == "x b0, " + ", ".join(f"a{i}" for i in range(1, n)) and got[7]["u"] is None
    assert (got[99]["t"], got[99]["u"]) == (None, "a1 b́ a2")


def test_lists_are_made_once(spark):
    from corpuscope.functions.items import items

    df = spark.createDataFrame([(["a ", "", "a"],), ([""],), ([],), (None,)], "x array<string>")
    plan = df.select(items(df, "x").alias("y"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1
    assert [r["y"] for r in plan.collect()] == [["a"], None, None, None]


def test_tokens_of_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a net of nets", ["net"], ["a net"])], "id int, abstract string, author_keywords array<string>, index_keywords array<string>")
    found = text.keywords_in_abstract(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Those that keywords are sought in are made above the join of the texts.
    assert "regexp_extract_all" in plan[: plan.index("Join LeftOuter")]
    assert found.select("abstract_keywords").first()[0] == ["a net"]
