"""Worked examples with known results."""

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import stem, text_keys
from corpuscope.operators import cleaning as C
from corpuscope.operators import filters as FI
from corpuscope.operators import graph as G
from corpuscope.operators import terms as T
from corpuscope.operators import text as X
from corpuscope.operators import thesaurus as TH
from corpuscope.sources.terms import read_thesaurus, write_thesaurus


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (2010, ["author 0"], ["w0"], 10, 0),
        (2010, ["author 0", "author 1", "author 2"], ["w0", "w1"], 11, 1),
        (2011, ["author 0"], ["w1"], 12, 2),
        (2011, ["author 3"], ["w3"], 13, 3),
        (2012, ["author 0", "author 2"], None, 14, 4),
        (2014, ["author 1"], ["w3", "w4"], 15, 5),
    ]
    return spark.createDataFrame(
        rows, "year int, authors array<string>, author_keywords array<string>, global_citations bigint, id bigint"
    )


def test_keys(spark):
    assert one(spark, "a A b", text_keys.fingerprint) == "a b"
    assert one(spark, " c b ", text_keys.fingerprint) == "b c"
    assert one(spark, None, text_keys.fingerprint) is None
    assert one(spark, "neural net", text_keys.one_gram) == "aelnrtu"
    assert one(spark, "neural net", text_keys.two_gram) == "aleteulnneraur"
    assert one(spark, "neural net", stem.stem_key) == "net neural"
    assert one(spark, "áéíóúñÁÉÍÓÚÑ", text_keys.remove_accents) == "aeiounAEIOUN"


def test_porter():
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster",
        "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
        "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic",
        "hopefulness": "hope", "allowance": "allow", "adjustable": "adjust", "adoption": "adopt",
        "controlling": "control", "rate": "rate", "cease": "ceas", "sky": "sky", "computers": "comput",
    }
    assert {w: stem.porter(w) for w in known} == known


TEXT = "one two three four five"


@pytest.mark.parametrize(
    "keyword, options, found",
    [
        ("111", {}, None),
        ("hre", {}, "hre"),
        (r"\btwo\b", {"use_re": True}, "two"),
        (r"\b(TWO)\b", {"use_re": True}, "two"),
        (r"\bTWO\b", {"use_re": True, "ignore_case": False}, None),
        (r"\btwo\Wthree\b", {"use_re": True, "ignore_case": False}, "two three"),
        (r"\bthree\W+two\b|\btwo\W+three\b", {"use_re": True}, "two three"),
        (r"\btwo\W+\w+\W+four\b", {"use_re": True}, "two three four"),
        (r"\btwo\W+(?:\w+\W+){1,3}?five", {"use_re": True}, "two three four five"),
        (r"123|two", {"use_re": True}, "two"),
    ],
)
def test_keyword_recipes(spark, keyword, options, found):
    assert one(spark, TEXT, X.KeywordSet([keyword], **options).extract) == found


def test_keyword_text(spark):
    k = X.KeywordSet(["aaa", "bbb"])
    assert one(spark, "1 aaa bbb 2 1 aaa 2", k.remove) == "1   2 1  2"
    a = X.KeywordSet(["aaa"])
    text = "1 aaa 4 aaa 5"
    assert one(spark, text, a.after_first) == "aaa 4 aaa 5"
    assert one(spark, text, a.after_last) == "aaa 5"
    assert one(spark, text, a.until_first) == "1 aaa"
    assert one(spark, text, a.until_last) == "1 aaa 4 aaa"
    assert one(spark, text, X.KeywordSet(["bbb"]).after_first) is None
    terms = spark.createDataFrame([(t,) for t in ["11", "111", "11 11 ", "a", "b", "c"]], "term string")
    new = X.transform_keywords(terms, X.KeywordSet(["1.*"], use_re=True))
    assert sorted(r[0] for r in new.collect()) == ["11", "11 11", "111"]


def test_nearby(spark):
    k = X.KeywordSet(["aaa", "bbb", "ccc"])
    cases = {
        "1. 2. 3. 4. 5. 6.": None,
        "aaa. 1. 2. 3. 4. 5.": "aaa. 1. 2.",
        "1. aaa. 2. 3. 4. 5.": "aaa. 2. 3.",
        "1. 2. 3. aaa. 4. 5.": "2. 3. aaa. 4. 5.",
        "1. 2. 3. 4. aaa. 5.": "3. 4. aaa.",
        "1. 2. 3. 4. 5. bbb.": "4. 5. bbb.",
    }
    for text, want in cases.items():
        assert one(spark, text, lambda c: k.nearby(c, 2)) == want


def test_find_terms(spark):
    df = spark.createDataFrame([(1, "aa;b"), (2, "c;d"), (3, "A"), (4, None)], "id int, x string")

    def found(**o):
        return sorted(r[0] for r in X.find_terms(df, "x", ["a"], **o).collect())

    assert found() == ["A", "aa"]
    assert found(ignore_case=False) == ["aa"]
    assert found(full_match=True) == ["A"]


def test_find_terms_by_stem(spark):
    terms = "Computer vision;Computer simulation;computer theory;control systems;Computer control systems;hardware"
    df = spark.createDataFrame([(1, terms)], "id int, x string")
    both = sorted(r[0] for r in X.find_terms_by_stem(df, "x", "control systems").collect())
    assert both == ["Computer control systems", "control systems"]
    either = sorted(r[0] for r in X.find_terms_by_stem(df, "x", "computer software", "or").collect())
    assert either == ["Computer control systems", "Computer simulation", "Computer vision", "computer theory"]


def test_thesaurus_patterns(spark):
    values = ["aaa", "bbb", "ccc aaa", "ccc bbb", "ddd eee", "ddd fff", None, "zzz"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x string")
    th = spark.createDataFrame([("aaa", v) for v in ("aaa", "bbb", "eee", "fff")] + [("1", "000")], "canonical string, variant string")
    for use_re in (False, True):
        got = [r["x"] for r in TH.apply_thesaurus_patterns(df, "x", th, use_re=use_re).orderBy("id").collect()]
        assert got == ["aaa"] * 6 + [None, "zzz"]
    up = df.withColumn("x", F.regexp_replace("x", "aaa", "AAA"))
    for use_re in (False, True):
        got = [r["x"] for r in TH.find_and_replace(up, "x", th, use_re=use_re).orderBy("id").collect()]
        assert got == ["aaa", "aaa", "ccc aaa", "ccc aaa", "ddd aaa", "ddd aaa", None, "zzz"]


def test_thesaurus_file(spark, tmp_path):
    th = spark.createDataFrame([("k1", "b"), ("k1", "a"), ("k0", "c d")], "canonical string, variant string")
    write_thesaurus(th, str(tmp_path / "th"))
    assert sorted(read_thesaurus(spark, str(tmp_path / "th")).collect()) == sorted(th.collect())
    (tmp_path / "bad.txt").write_text("k1\nk2\n    v\n")
    with pytest.raises(ValueError, match="k1"):
        read_thesaurus(spark, str(tmp_path / "bad.txt"))


def test_nesting_keeps_containment(spark):
    terms = ["a", "a b", "a b c", "a b c d", "a e", "a f", "a b e", "a b e f", "a b e f g"]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    parents = {r["term"]: r["parent"] for r in X.nest_terms(df).collect()}
    assert set(parents) == set(terms) - {"a"}
    assert all(set(p.split()) < set(t.split()) for t, p in parents.items())
    assert parents["a b e f g"] == "a b e f" and parents["a b c d"] == "a b c"


def test_author_suffixes(spark):
    rows = [
        (0, ["author 0", "author 0", "author 0"], ["0", "1", "2"]),
        (1, ["author 0", "author 0"], ["3", "4"]),
        (2, ["author 1", "author 0"], ["6", "0"]),
    ]
    df = spark.createDataFrame(rows, "id bigint, authors array<string>, authors_id array<string>")
    got = [r["authors"] for r in C.disambiguate_authors(df).orderBy("id").collect()]
    assert got == [
        ["author 0", "author 0(1)", "author 0(2)"],
        ["author 0(3)", "author 0(4)"],
        ["author 1", "author 0"],
    ]


def test_terms_by_terms_by_year(spark, corpus):
    got = T.terms_by_terms_by_year(corpus, "authors", "author_keywords", ["w0", "w3"]).orderBy("term_a", "term_b", "year")
    assert [tuple(r) for r in got.collect()] == [
        ("author 0", "w0", 2010, 2, 21),
        ("author 1", "w0", 2010, 1, 11),
        ("author 1", "w3", 2014, 1, 15),
        ("author 2", "w0", 2010, 1, 11),
        ("author 3", "w3", 2011, 1, 13),
    ]


def test_time_analysis_fills_gaps(spark, corpus):
    rows = {r["year"]: tuple(r)[1:5] for r in T.time_analysis(corpus).collect()}
    assert rows[2013] == (0, 0, 5, 60) and rows[2014] == (1, 15, 6, 75)


def test_record_filter(spark, corpus):
    zoned = corpus.withColumn("bradford_law_zone", F.when(F.col("id") < 3, 1).cast("int"))
    kept = FI.filter_records(zoned, FI.RecordFilter(years=(2010, 2011), citations=(11, 99), bradford_law_zone=2))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2]


CITES = {
    "C": "AB", "D": "B", "E": "C", "F": "D", "G": "E", "H": "GCF", "I": "FD", "J": "B", "K": "H", "L": "I", "M": "IJ", "N": "M",
}


def test_main_path_against_enumeration(spark):
    edges = [(cited, citing) for citing, all_cited in CITES.items() for cited in all_cited]
    nxt = {}
    for a, b in edges:
        nxt.setdefault(a, []).append(b)
    targets = {b for _, b in edges}

    def walk(p):
        return [p] if p[-1] not in nxt else [q for b in nxt[p[-1]] for q in walk(p + [b])]

    paths = [q for a in nxt if a not in targets for q in walk([a])]
    count = {e: sum(e in zip(p, p[1:]) for p in paths) for e in edges}
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {(r["src"], r["dst"]): int(r["count"]) for r in G.path_counts(df).collect()}
    assert got == count
    value = [sum(count[e] for e in zip(p, p[1:])) for p in paths]
    keep = set()
    for e in [e for e in edges if count[e] == max(count.values())]:
        through = [(v, p) for v, p in zip(value, paths) if e in zip(p, p[1:])]
        for v, p in through:
            if v == max(v for v, _ in through):
                keep |= set(zip(p, p[1:]))
    for v, p in zip(value, paths):
        if v == max(value):
            keep |= set(zip(p, p[1:]))
    assert {(r["src"], r["dst"]) for r in G.main_path(df).collect()} == keep


def test_cycle_is_an_error(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    with pytest.raises(ValueError, match="cycle"):
        G.path_counts(df)


def test_longest_keyword_claims_its_words(spark):
    df = spark.createDataFrame(
        [(1, "A neural net, and a net of nets.", ["neural net", "net"], ["nets"]), (2, "Neural net only.", ["net"], None)],
        "id int, abstract string, author_keywords array<string>, index_keywords array<string>",
    )
    out = {r["id"]: r for r in X.keywords_in_abstract(df).collect()}
    assert out[1]["abstract_keywords"] == ["net", "nets", "neural net"]
    assert out[1]["abstract_index_keywords"] == ["nets"]
    assert out[2]["abstract_author_keywords"] == ["neural net"]


def test_country_and_institution(spark):
    names = C.country_names(spark)
    rows = [
        ("Universidad de Antioquia, Medellin, Colombia",),
        ("Department of Physics, University of Antioquia, Medellin, Colombia",),
        ("MIT, Cambridge, MA, USA",),
        ("Univ. of Nowhere",),
        ("Institute of Usability, Brasil",),
    ]
    df = spark.createDataFrame(rows, "affiliation string")
    found = {r["affiliation"]: r["code"] for r in C.extract_country(df, names).collect()}
    assert [found[r[0]] for r in rows] == ["COL", "COL", "USA", None, "BRA"]
    docs = df.select(F.monotonically_increasing_id().alias("id"), F.array("affiliation").alias("affiliations"))
    th, ignored = C.institution_thesaurus(docs, names)
    canonical = {r["variant"]: r["canonical"] for r in th.collect()}
    assert canonical[rows[1][0].lower()] == "Universidad de Antioquia COL"
    assert canonical[rows[0][0].lower()] == "Universidad de Antioquia COL"
    assert {r[0] for r in ignored.collect()} == {"mit, cambridge, ma, usa", "univ. of nowhere"}
