"""Queries on texts, thesauri and record cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions import items as I
from corpuscope.functions import stem, text_keys
from corpuscope.operators import cleaning as C
from corpuscope.operators import text as X
from corpuscope.operators import thesaurus as TH

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


TOKEN = r"[\p{L}\p{N}_\-]+"


def texts(spark, sf):
    """Documents with their words as author keywords."""
    d = table(spark, sf, "documents")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))))
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"), "lang", "source",
                    (F.col("n_chars") % 100).alias("global_citations"),
                    F.get(F.filter(F.array(words), lambda x: F.size(x) > 0), F.lit(0)).alias("author_keywords"))


def with_abstracts(spark, sf, orders):
    """Orders with a text each: the documents in turn."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("_doc"), F.col("text").alias("abstract"))
    return orders.withColumn("_doc", F.col("id") % d.count()).join(d, "_doc").drop("_doc")


def benchmark_words(spark, sf):
    """Distinct words of the benchmark items."""
    return table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term")).distinct()


_WORDS = r"""words AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS term FROM documents)"""
_BW = r"""bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark)"""
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_FP_NORM = r"""strip_accents(regexp_replace(replace(lower(trim({c}, E' \n\t\r')), '-', ' '), '[!"#$%&''()*+,./:;<=>?@\[\]^_`{{|}}~-]', '', 'g'))"""
_FP = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(" + _FP_NORM + r", '\s+'), lambda x: x <> ''))), ' ')"


def titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", "html", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


# ----------------------------------------------------------------------- keys

@query("fingerprint", f"SELECT page_id, {_FP.format(c=_TITLE)} AS key FROM pages")
def _(spark, sf):
    return titles(spark, sf).select("page_id", text_keys.fingerprint("title").alias("key"))


@query("one_gram", "SELECT page_id, array_to_string(list_sort(list_distinct(string_split(regexp_replace(" + _FP_NORM.format(c=_TITLE) + r", '\s', '', 'g'), ''))), '') AS key FROM pages")
def _(spark, sf):
    return titles(spark, sf).select("page_id", text_keys.one_gram("title").alias("key"))


@query("two_gram", "WITH t AS (SELECT page_id, regexp_replace(" + _FP_NORM.format(c=_TITLE) + r""", '\s', '', 'g') AS t FROM pages),
g AS (SELECT page_id, t, unnest(range(1, greatest(len(t), 1))) AS i FROM t)
SELECT pages.page_id, coalesce(k, '') AS key FROM pages LEFT JOIN (SELECT page_id, string_agg(DISTINCT substr(t, i, 2), '' ORDER BY substr(t, i, 2)) AS k FROM g GROUP BY 1) USING (page_id)""")
def _(spark, sf):
    return titles(spark, sf).select("page_id", text_keys.two_gram("title").alias("key"))


@query("remove_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text_keys.remove_accents("text").alias("plain"))


@query("stem_key")
def _(spark, sf):
    words = texts(spark, sf).select(F.explode("author_keywords").alias("term")).distinct()
    return words.select("term", stem.stem_key("term").alias("key"))


# Stems worked out by hand from the published rules: adverbs and plurals of the words of parts.
_STEMS = """stems(word, stem) AS (VALUES ('newly', 'newli'), ('hotly', 'hot'), ('coldly', 'cold'), ('redly', 'red'),
 ('oldly', 'old'), ('largely', 'larg'), ('smallly', 'smallli'), ('bluely', 'blueli'), ('bolts', 'bolt'), ('plates', 'plate'),
 ('rods', 'rod'), ('gears', 'gear'), ('gizmos', 'gizmo'), ('anvils', 'anvil'), ('widgets', 'widget'), ('rings', 'ring'),
 ('new', 'new'), ('hot', 'hot'), ('cold', 'cold'), ('red', 'red'), ('old', 'old'), ('large', 'larg'), ('small', 'small'),
 ('blue', 'blue'), ('bolt', 'bolt'), ('plate', 'plate'), ('rod', 'rod'), ('gear', 'gear'), ('gizmo', 'gizmo'),
 ('anvil', 'anvil'), ('widget', 'widget'), ('ring', 'ring'))"""
_FORMS = _STEMS + """, p AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS n FROM part),
forms AS (SELECT a || ' ' || n AS term, a, n FROM p UNION SELECT a || 'ly ' || n, a || 'ly', n FROM p
 UNION SELECT a || 'ly ' || n || 's', a || 'ly', n || 's' FROM p UNION SELECT n || 's ' || a, a, n || 's' FROM p),
keyed AS (SELECT term, least(x.stem, y.stem) || ' ' || greatest(x.stem, y.stem) AS key FROM forms JOIN stems x ON x.word = a JOIN stems y ON y.word = n)"""


def part_forms(spark, sf):
    """Names of parts as they are, as adverbs, in the plural and the other way round."""
    words = F.split("p_name", " ")
    a, n, s = words[0], words[1], F.lit("s")
    forms = F.array(
        F.concat_ws(" ", a, n), F.concat(a, F.lit("ly "), n), F.concat(a, F.lit("ly "), n, s), F.concat(n, F.lit("s "), a))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), forms.alias("forms"))


@query("stem_key_snowball", "WITH " + _FORMS + " SELECT DISTINCT term, key FROM keyed")
def _(spark, sf):
    terms = part_forms(spark, sf).select(F.explode("forms").alias("term")).distinct()
    return terms.select("term", stem.stem_key("term", "snowball").alias("key"))


@query("find_terms_by_stem_snowball", "WITH " + _FORMS + " SELECT DISTINCT term FROM keyed WHERE contains(key, 'larg plate')")
def _(spark, sf):
    return X.find_terms_by_stem(part_forms(spark, sf), "forms", "plated largely", kind="snowball")


@query("find_terms", with_views("ik") + r" SELECT DISTINCT term FROM ik WHERE regexp_matches(term, '(?i)RED|^old.*t$')")
def _(spark, sf):
    c = corpus(spark, sf, "index_keywords")
    return X.find_terms(c, "index_keywords", ["RED", "^old.*t$"], use_re=True)


@query("find_terms_full_match", with_views("ik") + " SELECT DISTINCT term FROM ik WHERE lower(term) = 'red bolt'")
def _(spark, sf):
    return X.find_terms(corpus(spark, sf, "index_keywords"), "index_keywords", ["Red Bolt"], full_match=True)


@query("find_terms_by_stem_and", with_views("ik") + " SELECT DISTINCT term FROM ik WHERE term = 'red bolt'")
def _(spark, sf):
    return X.find_terms_by_stem(corpus(spark, sf, "index_keywords"), "index_keywords", "bolts red")


@query("find_terms_by_stem_or", with_views("ik") + " SELECT DISTINCT term FROM ik WHERE contains(term, 'red') OR contains(term, 'bolt')")
def _(spark, sf):
    return X.find_terms_by_stem(corpus(spark, sf, "index_keywords"), "index_keywords", "bolts red", "or")


# ------------------------------------------------------------------- keywords

_SET = ["tion", "that", "ment"]


@query("extract_keywords", """SELECT doc_id AS id, CASE WHEN len(k) > 0 THEN array_to_string(k, ';') END AS found FROM (
SELECT doc_id, list_sort(list_distinct(flatten([list_filter(list_transform(string_split(text, ';'), lambda p: regexp_extract(p, '(?i)' || w)), lambda x: x <> '') for w in ['tion', 'that', 'ment']]))) AS k FROM documents)""")
def _(spark, sf):
    return X.extract_keywords(texts(spark, sf), "abstract", X.KeywordSet(_SET), "found").select("id", "found")


@query("contains_keywords", "SELECT doc_id AS id, regexp_matches(text, '(?i)tion|that|ment') AS found FROM documents")
def _(spark, sf):
    return X.contains_keywords(texts(spark, sf), "abstract", X.KeywordSet(_SET), "found").select("id", "found")


@query("remove_keywords", "SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)ment', '', 'g'), '(?i)that', '', 'g'), '(?i)tion', '', 'g') AS rest FROM documents")
def _(spark, sf):
    return X.remove_keywords(texts(spark, sf), "abstract", X.KeywordSet(_SET), "rest").select("id", "rest")


@query("transform_keywords", with_views("ik") + r""" SELECT DISTINCT regexp_extract(term, 'old|b[a-z]+') AS term FROM ik WHERE regexp_matches(term, 'old|b[a-z]+') AND NOT (regexp_matches(term, 'old') AND regexp_matches(term, 'b[a-z]+'))
UNION SELECT DISTINCT regexp_extract(term, 'b[a-z]+') || ';old' FROM ik WHERE regexp_matches(term, 'old') AND regexp_matches(term, 'b[a-z]+')""")
def _(spark, sf):
    vocab = X.keyword_vocabulary(corpus(spark, sf, "index_keywords"), "index_keywords")
    return X.transform_keywords(vocab, X.KeywordSet(["old", "b[a-z]+"], use_re=True))


@query("extract_keywords_from_table", "WITH " + _BW + " SELECT doc_id AS id, term FROM documents JOIN bw ON contains(lower(text), term)")
def _(spark, sf):
    return X.extract_keywords_from_table(texts(spark, sf), "abstract", benchmark_words(spark, sf))


_AT = "strpos(lower(text), 'tion')"


@query("extract_after_first", f"SELECT doc_id AS id, CASE WHEN {_AT} > 0 THEN substr(text, {_AT}) END AS part FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("id", X.KeywordSet(["tion"]).after_first(F.col("abstract")).alias("part"))


@query("extract_after_last", "SELECT doc_id AS id, CASE WHEN strpos(lower(text), 'tion') > 0 THEN right(text, strpos(reverse(lower(text)), 'noit') + 3) END AS part FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("id", X.KeywordSet(["tion"]).after_last(F.col("abstract")).alias("part"))


@query("extract_until_first", f"SELECT doc_id AS id, CASE WHEN {_AT} > 0 THEN substr(text, 1, {_AT} + 3) END AS part FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("id", X.KeywordSet(["tion"]).until_first(F.col("abstract")).alias("part"))


@query("extract_until_last", "SELECT doc_id AS id, CASE WHEN strpos(lower(text), 'tion') > 0 THEN substr(text, 1, len(text) - strpos(reverse(lower(text)), 'noit') + 1) END AS part FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("id", X.KeywordSet(["tion"]).until_last(F.col("abstract")).alias("part"))


@query("extract_nearby", r"""WITH s AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, '.'), lambda p: trim(p, ' ')), lambda p: p <> '') AS l FROM documents),
p AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM s), h AS (SELECT * FROM p WHERE contains(lower(l[i]), 'that'))
SELECT s.id, part FROM s LEFT JOIN (SELECT id, string_agg(CASE WHEN i > 1 THEN l[i - 1] || '. ' ELSE '' END || l[i] || CASE WHEN i < len(l) THEN '. ' || l[i + 1] ELSE '' END, '. ' ORDER BY i) || '.' AS part FROM h GROUP BY id) USING (id)""")
def _(spark, sf):
    return X.extract_nearby(texts(spark, sf), "abstract", X.KeywordSet(["that"]), 1, "part").select("id", "part")


@query("sentences", r"""WITH s AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '[.:?!]'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS l FROM documents)
SELECT id, CAST(i AS INTEGER) AS pos, l[i + 1] AS sentence FROM (SELECT id, l, unnest(range(len(l))) AS i FROM s)""")
def _(spark, sf):
    return X.sentences(texts(spark, sf), "abstract")


@query("neighbourhood", r"""WITH s AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '[.:?!]'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS l FROM documents)
SELECT id, CAST(i AS INTEGER) AS pos, l[i + 1] AS sentence, array_to_string(l[greatest(i - 1, 1):least(i + 3, len(l))], '. ') AS context FROM (SELECT id, l, unnest(range(len(l))) AS i FROM s)""")
def _(spark, sf):
    return X.neighbourhood(texts(spark, sf), "abstract", 2)


def _conc_sql(cond):
    return f"""WITH h AS (SELECT doc_id AS id, n_chars % 100 AS c, list_filter(string_split(text, '. '), lambda s: {cond}) AS l FROM documents)
SELECT id, c AS global_citations, array_to_string(l, '. ') || '.' AS concordance FROM h WHERE len(l) > 0 ORDER BY c DESC, id LIMIT 50"""


@query("concordances", _conc_sql("contains(lower(s), 'there')"))
def _(spark, sf):
    return X.concordances(texts(spark, sf), ["There"]).select("id", "global_citations", "concordance")


@query("concordances_of_two", _conc_sql("contains(lower(s), 'that') AND contains(lower(s), 'with')"))
def _(spark, sf):
    return X.concordances(texts(spark, sf), ["that", "with"]).select("id", "global_citations", "concordance")


@query("co_mentioned", "WITH " + _WORDS + """, k AS (SELECT DISTINCT term FROM words),
s AS (SELECT DISTINCT s FROM (SELECT unnest(string_split(lower(text), '. ')) AS s FROM documents) WHERE contains(s, 'that'))
SELECT DISTINCT term FROM k JOIN s ON contains(s, term)""")
def _(spark, sf):
    return X.co_mentioned(texts(spark, sf), "author_keywords", "that")


@query("mentioned_keywords", with_views("ik") + """, d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT DISTINCT w AS term FROM (SELECT id, unnest(string_split(term, ' ')) AS w FROM ik)
JOIN d ON doc_id = id % (SELECT count(*) FROM documents) WHERE contains(t, w)""")
def _(spark, sf):
    c = corpus(spark, sf, "index_keywords").withColumn(
        "words", F.array_distinct(F.flatten(F.transform("index_keywords", lambda x: F.split(x, " ")))))
    return X.mentioned_keywords(with_abstracts(spark, sf, c), "words")


@query("keywords_in_abstract", "WITH " + _WORDS + r""", v AS (SELECT DISTINCT term FROM words),
t AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]+|[^\s\p{L}\p{N}_\-]') AS l FROM documents)),
n AS (SELECT id, w, lag(w) OVER (PARTITION BY id ORDER BY i) IS NOT DISTINCT FROM 'the' AND w <> 'the' AS pair, lead(w) OVER (PARTITION BY id ORDER BY i) AS nxt FROM t),
p AS (SELECT id, w, pair FROM n WHERE w <> 'the' OR nxt IS NULL OR nxt = 'the' OR nxt NOT IN (SELECT term FROM v)),
h AS (SELECT DISTINCT id, CASE WHEN pair THEN 'the ' || w ELSE w END AS k, pair FROM p JOIN v ON term = w),
g AS (SELECT id, string_agg(k, ';' ORDER BY k) AS a, coalesce(string_agg(k, ';' ORDER BY k) FILTER (WHERE NOT pair), '') AS b,
      coalesce(string_agg(k, ';' ORDER BY k) FILTER (WHERE pair), '') AS c FROM h GROUP BY id)
SELECT doc_id AS id, a AS abstract_keywords, b AS abstract_author_keywords, c AS abstract_index_keywords
FROM documents LEFT JOIN g ON id = doc_id""")
def _(spark, sf):
    d = texts(spark, sf)
    # Pairs that cannot overlap, so that SQL can say which run claims a word.
    pairs = F.transform(F.array_remove("author_keywords", "the"), lambda w: F.concat(F.lit("the "), w))
    out = X.keywords_in_abstract(d.withColumn("index_keywords", pairs))
    return out.select("id", *[F.array_join(c, ";").alias(c) for c in
                              ("abstract_keywords", "abstract_author_keywords", "abstract_index_keywords")])


@query("to_american", "WITH " + _BW + r""", t AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS i FROM documents)
SELECT id, string_agg(CASE WHEN bw.term IS NOT NULL THEN reverse(w) ELSE w END, '' ORDER BY i) AS abstract FROM t LEFT JOIN bw ON w = bw.term GROUP BY id""")
def _(spark, sf):
    spelling = benchmark_words(spark, sf).select(F.col("term").alias("british"), F.reverse("term").alias("american"))
    return X.to_american(texts(spark, sf), ["abstract"], spelling).select("id", "abstract")


@query("extract_words")
def _(spark, sf):
    d = texts(spark, sf)
    pairs = d.select(F.explode("author_keywords").alias("w")).select(F.concat(F.lit("the "), "w").alias("term")).distinct()
    return X.extract_words(d, "abstract", pairs).select("id", F.array_join("words", " ").alias("words"))


@query("collocations", r"""WITH t AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]+') AS l FROM documents),
s AS (SELECT w, count(*) AS n FROM (SELECT unnest(l) AS w FROM t) GROUP BY w), g AS (SELECT sum(n) AS g FROM s),
p AS (SELECT a, b, count(*) AS o FROM (SELECT unnest(l[1:len(l) - 1]) AS a, unnest(l[2:len(l)]) AS b FROM t WHERE len(l) > 1) GROUP BY a, b HAVING count(*) >= 5),
x AS (SELECT a, b, o::DOUBLE AS o, sa.n::DOUBLE AS n1, sb.n::DOUBLE AS n2, g::DOUBLE AS g FROM p JOIN s sa ON a = sa.w JOIN s sb ON b = sb.w, g
 WHERE len(a) > 2 AND len(b) > 2 AND a NOT IN (STOP) AND b NOT IN (STOP)),
y AS (SELECT *, n1 - o AS o10, n2 - o AS o01, g - n1 - n2 + o AS o00 FROM x)
SELECT a AS w1, b AS w2, CAST(o AS BIGINT) AS num_pairs,
 round(2 * (o * ln(o / (n1 * n2 / g)) + CASE WHEN o10 > 0 THEN o10 * ln(o10 / (n1 * (g - n2) / g)) ELSE 0 END
 + CASE WHEN o01 > 0 THEN o01 * ln(o01 / ((g - n1) * n2 / g)) ELSE 0 END + CASE WHEN o00 > 0 THEN o00 * ln(o00 / ((g - n1) * (g - n2) / g)) ELSE 0 END), 4) AS llr,
 round(log2(o * g / n1 / n2), 4) AS pmi FROM y ORDER BY 4 DESC, 1, 2 LIMIT 20""")
def _(spark, sf):
    out = X.collocations(texts(spark, sf), "abstract", 20, 5)
    return out.withColumns({"llr": F.round("llr", 4), "pmi": F.round("pmi", 4)})


# The English stop words of Spark's StopWordsRemover that occur in the test texts.
_STOP = ["the", "that", "and", "for", "are", "was", "with", "his", "they", "this", "have", "from", "had", "but", "not", "what", "all", "were", "when", "your", "can", "there", "use", "each", "which", "she", "how", "their", "will", "other", "about", "out", "many", "then", "them", "these", "her", "would", "him", "into", "has", "more", "see", "could", "did", "than", "who", "its", "now", "you", "our", "own", "nor", "too", "very", "any", "both", "few", "most", "some", "such", "only", "same", "once", "here", "where", "why", "again", "further", "during", "before", "after", "above", "below", "down", "off", "over", "under", "through", "between", "against", "because", "until", "while", "being", "been", "having", "does", "doing", "itself", "himself", "herself", "themselves", "myself", "yourself", "ourselves", "yours", "ours", "hers", "theirs", "whom", "those", "should", "just", "don", "ought"]
SQL["collocations"] = SQL["collocations"].replace("STOP", ", ".join(f"'{w}'" for w in _STOP))


@query("highlight", "SELECT doc_id AS id, regexp_replace(regexp_replace(text, '(?i)there', 'THERE', 'g'), '(?i)the', 'THE', 'g') AS abstract FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("id", X.highlight(F.col("abstract"), ["the", "there"]).alias("abstract"))


@query("complete_keywords", "WITH " + _WORDS + """, poor AS (SELECT doc_id AS id FROM labels WHERE quality = 0),
kw AS (SELECT id, term FROM words WHERE id NOT IN (SELECT id FROM poor)), v AS (SELECT DISTINCT term FROM kw),
m AS MATERIALIZED (SELECT doc_id AS id, lower(source || ' ' || text) AS t FROM documents WHERE doc_id NOT IN (SELECT id FROM kw)),
f AS (SELECT id, term FROM m JOIN v ON contains(t, term)),
u AS (SELECT id, term FROM kw UNION ALL SELECT id, term FROM f)
SELECT doc_id AS id, string_agg(term, ';' ORDER BY term) AS author_keywords FROM documents LEFT JOIN u ON id = doc_id GROUP BY doc_id""")
def _(spark, sf):
    poor = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"), F.lit(True).alias("poor")).distinct()
    d = texts(spark, sf).join(poor, "id", "left")
    d = d.withColumn("author_keywords", F.when(F.col("poor").isNull() & (F.size("author_keywords") > 0), F.col("author_keywords")))
    out = X.complete_keywords(d, texts=("source", "abstract"))
    return out.select("id", F.array_join("author_keywords", ";").alias("author_keywords"))


@query("merge_text", "SELECT d.doc_id AS id, concat_ws(' ', lang, CASE WHEN quality = 1 THEN text END) AS merged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    d = d.withColumn("text", F.when(F.col("quality") == 1, F.col("text")))
    return d.select(F.col("doc_id").alias("id"), I.merge_text(["lang", "text"]).alias("merged"))


@query("nest_terms", """WITH t AS (SELECT p_name AS term FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT split_part(p_name, ' ', 2) || ' ' || p_type FROM part),
w AS (SELECT term, list_distinct(string_split(lower(term), ' ')) AS w FROM t),
p AS (SELECT c.term, q.term AS parent, len(q.w) AS n FROM w c JOIN w q ON list_has_all(c.w, q.w) AND c.term <> q.term WHERE len(q.w) < len(c.w) OR q.term < c.term)
SELECT term, arg_max(parent, n * 1000000 - r) AS parent FROM (SELECT *, row_number() OVER (ORDER BY parent) AS r FROM p) GROUP BY term""")
def _(spark, sf):
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    terms = p.select(F.explode(F.array("p_name", words[0], F.concat_ws(" ", words[1], "p_type"))).alias("term"))
    return X.nest_terms(terms)


# ------------------------------------------------------------------- thesauri

def brand_groups(spark, sf):
    """Thesaurus Group#(i mod 5) of the brands Brand#i."""
    return _grouped(table(spark, sf, "part"))


def last_brands(spark, sf):
    """The same of the last brand of each type of part, so that other brands have no entry."""
    return _grouped(table(spark, sf, "part").groupBy("p_type").agg(F.max("p_brand").alias("p_brand")))


def _grouped(brands):
    number = F.substring("p_brand", 7, 9).cast("int")
    return brands.select(
        F.concat(F.lit("Group#"), number % 5).alias("canonical"), F.col("p_brand").alias("variant")).distinct()


_GROUP = "'Group#' || (CAST(substr(term, 7) AS INTEGER) % 5)"


_LAST = ", lb AS (SELECT DISTINCT max(p_brand) AS v FROM part GROUP BY p_type)"


@query("apply_thesaurus_strict", with_views("docs", "kw") + _LAST + f"""
SELECT docs.id, string_agg(DISTINCT {_GROUP}, ';' ORDER BY {_GROUP}) AS author_keywords
FROM docs LEFT JOIN (kw JOIN lb ON v = term) ON kw.id = docs.id GROUP BY docs.id""")
def _(spark, sf):
    out = TH.apply_thesaurus(corpus(spark, sf, "author_keywords"), "author_keywords", last_brands(spark, sf), strict=True)
    return out.select("id", F.array_join(F.array_sort("author_keywords"), ";").alias("author_keywords"))


@query("apply_thesaurus", with_views("docs", "kw") + _LAST + f""", m AS (SELECT id, CASE WHEN v IS NOT NULL THEN {_GROUP} ELSE term END AS t FROM kw LEFT JOIN lb ON v = term)
SELECT docs.id, string_agg(DISTINCT t, ';' ORDER BY t) AS author_keywords FROM docs LEFT JOIN m USING (id) GROUP BY docs.id""")
def _(spark, sf):
    out = TH.apply_thesaurus(corpus(spark, sf, "author_keywords"), "author_keywords", last_brands(spark, sf))
    return out.select("id", F.array_join(F.array_sort("author_keywords"), ";").alias("author_keywords"))


def _word_thesaurus(spark, sf):
    return table(spark, sf, "part").select(
        F.upper(F.split("p_name", " ")[1]).alias("canonical"), F.split("p_name", " ")[0].alias("variant")).distinct()


_WT = "th AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) AS c, split_part(p_name, ' ', 1) AS v FROM part)"


@query("apply_thesaurus_patterns", "WITH " + _WT + """, b AS (SELECT doc_id, min(c) AS c FROM documents JOIN th ON contains(lower(text), v) GROUP BY doc_id)
SELECT doc_id, coalesce(c, trim(text, ' ')) AS text FROM documents LEFT JOIN b USING (doc_id)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return TH.apply_thesaurus_patterns(d, "text", _word_thesaurus(spark, sf))


@query("apply_thesaurus_full_match", "WITH " + _WT + ", b AS (SELECT v, min(c) AS c FROM th GROUP BY v) SELECT l.p_partkey, coalesce(c, w) AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) l LEFT JOIN b ON v = w")
def _(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return TH.apply_thesaurus_patterns(words, "word", _word_thesaurus(spark, sf), ignore_case=False, full_match=True)


@query("apply_thesaurus_regex", r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)^(cold|hot) ') THEN 'thermal' WHEN regexp_matches(p_name, '(?i)b[a-z]lt$') THEN 'fastener' ELSE p_name END AS p_name FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    th = p.agg(F.max("p_size")).select(F.inline(F.array(
        F.struct(F.lit("fastener").alias("canonical"), F.lit("b[a-z]lt$").alias("variant"), F.lit(2).alias("rank")),
        F.struct(F.lit("thermal").alias("canonical"), F.lit("^(COLD|hot) ").alias("variant"), F.lit(1).alias("rank")))))
    return TH.apply_thesaurus_patterns(p.select("p_partkey", "p_name"), "p_name", th, use_re=True)


@query("find_and_replace", "WITH " + _WT + """, b AS (SELECT p_partkey, arg_min(replace(p_name, v, c), c || ' ' || v) AS t FROM part JOIN th ON contains(p_name, v) GROUP BY p_partkey)
SELECT p_partkey, coalesce(t, p_name) AS p_name FROM part LEFT JOIN b USING (p_partkey)""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return TH.find_and_replace(p, "p_name", _word_thesaurus(spark, sf))


_CLUSTER = r"""WITH r AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS term FROM documents),
t AS (SELECT term, count(*) AS n FROM r WHERE term <> '' GROUP BY 1),
b AS (SELECT term, n, CASE WHEN regexp_matches(term, '^[^\[]*\[[^\]]*\]') THEN trim(regexp_replace(term, '^([^\[]*)\[[^\]]*\]', '\1')) ELSE term END AS a FROM t),
c AS (SELECT term, n, CASE WHEN regexp_matches(a, '^[^(]*\([^)]*\)') THEN trim(regexp_replace(a, '^([^(]*)\([^)]*\)', '\1')) ELSE a END AS a FROM b),
"""


@query("cluster_terms", _CLUSTER + f"""k AS (SELECT term, n, {_FP.format(c="replace(replace(a, '&', 'and'), ' of ', '')")} AS k FROM c),
m AS (SELECT k, coalesce(min(term) FILTER (contains(term, '-')), arg_min(term, {{'n': -n, 't': term}})) AS canonical FROM k GROUP BY k)
SELECT canonical, term AS variant FROM k JOIN m USING (k)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split("text", r"\s+").alias("words"))
    return TH.cluster_terms(d, "words", key="fingerprint")


@query("cluster_terms_by_title", f"""WITH t AS (SELECT trim({_TITLE}, ' ') AS term, count(*) AS n FROM pages GROUP BY 1 HAVING term <> ''),
k AS (SELECT term, n, {_FP.format(c="replace(replace(term, '&', 'and'), ' of ', '')")} AS k FROM t),
m AS (SELECT k, coalesce(min(term) FILTER (contains(term, '-')), min(term)) AS canonical FROM k GROUP BY k)
SELECT canonical, term AS variant FROM k JOIN m USING (k)""")
def _(spark, sf):
    d = titles(spark, sf).select(F.col("page_id").alias("id"), F.array("title").alias("title"))
    return TH.cluster_terms(d, "title", key="fingerprint", name_strategy="alphabetical")


@query("cluster_terms_snowball", "WITH " + _FORMS + """, names AS (SELECT key, min(term) AS canonical FROM keyed GROUP BY key)
SELECT DISTINCT canonical, term AS variant FROM keyed JOIN names USING (key)""")
def _(spark, sf):
    return TH.cluster_terms(part_forms(spark, sf), "forms", key="snowball", name_strategy="alphabetical")


@query("keywords_thesaurus")
def _(spark, sf):
    return TH.keywords_thesaurus(texts(spark, sf), ["author_keywords"])


@query("apply_keywords_thesaurus", with_views("docs", "kw", "ik") + f""", m AS (SELECT id, {_GROUP} AS t FROM kw UNION SELECT id, term FROM ik)
SELECT docs.id, string_agg(t, ';' ORDER BY t) AS keywords_cleaned FROM docs LEFT JOIN m USING (id) GROUP BY docs.id""")
def _(spark, sf):
    out = TH.apply_keywords_thesaurus(corpus(spark, sf, "author_keywords", "index_keywords"), brand_groups(spark, sf))
    return out.select("id", F.array_join("keywords_cleaned", ";").alias("keywords_cleaned"))


_BG = "WITH b AS (SELECT DISTINCT 'Group#' || (CAST(substr(p_brand, 7) AS INTEGER) % 5) AS c, p_brand AS v FROM part) "


@query("thesaurus_merge_keys", _BG + "SELECT CASE WHEN c IN ('Group#1', 'Group#2') THEN 'Group#0' ELSE c END AS canonical, v AS variant FROM b")
def _(spark, sf):
    return TH.merge_keys(brand_groups(spark, sf), "Group#0", ["Group#1", "Group#2"])


@query("thesaurus_merge_keys_from", _BG + "SELECT coalesce(p.c2, b.c) AS canonical, v AS variant FROM b LEFT JOIN (SELECT DISTINCT 'Group#' || r_regionkey AS c, r_name AS c2 FROM region) p USING (c)")
def _(spark, sf):
    merges = table(spark, sf, "region").select(
        F.col("r_name").alias("canonical"), F.concat(F.lit("Group#"), "r_regionkey").alias("variant"))
    return TH.merge_keys_from(brand_groups(spark, sf), merges)


@query("thesaurus_pop_key", _BG + "SELECT c AS canonical, v AS variant FROM b WHERE c <> 'Group#3'")
def _(spark, sf):
    return TH.pop_key(brand_groups(spark, sf), "Group#3")


@query("thesaurus_change_key", _BG + "SELECT CASE WHEN c = 'Group#3' THEN 'third' ELSE c END AS canonical, v AS variant FROM b")
def _(spark, sf):
    return TH.change_key(brand_groups(spark, sf), "Group#3", "third")


@query("thesaurus_invert", _BG + "SELECT v AS variant, c AS canonical FROM b")
def _(spark, sf):
    return TH.invert(brand_groups(spark, sf))


@query("thesaurus_find_keys", _BG + "SELECT DISTINCT c AS canonical FROM b WHERE v LIKE '%#17%' OR v LIKE '%#8%'")
def _(spark, sf):
    return TH.find_keys(brand_groups(spark, sf), ["#17", "#8"])


# ------------------------------------------------------------------- cleaning

@query("clean_authors", with_views("docs", "au") + """
SELECT docs.id, string_agg(replace(lower(term), '#', ' '), ';' ORDER BY term) AS authors FROM docs LEFT JOIN au USING (id) GROUP BY docs.id""")
def _(spark, sf):
    c = corpus(spark, sf, "authors")
    raw = c.select("id", F.coalesce(F.array_join(F.transform(F.array_sort("authors"), lambda a: F.concat(
        F.regexp_replace(F.lower(a), "#", " "), F.lit("."))), ", "), F.lit("[No author name available]")).alias("authors"))
    return C.clean_authors(raw).select("id", F.array_join("authors", ";").alias("authors"))


@query("suffix_order", """WITH s AS (SELECT n_name AS name, s_name AS author_id, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS r FROM s)
SELECT name, author_id, name || CASE WHEN r > 1 THEN '(' || (r - 1) || ')' ELSE '' END AS label FROM r""")
def _(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("n_name").alias("name"), F.col("s_name").alias("author_id"), "s_suppkey")
    return C.suffix_order(s, "name", "author_id", ["s_suppkey"]).select("name", "author_id", "label")


@query("disambiguate_authors", """WITH l AS (SELECT l_orderkey AS id, n_name AS name, s_name AS aid, l_linenumber, s_suppkey,
  dense_rank() OVER (PARTITION BY l_orderkey ORDER BY s_name) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT name, aid, min(id * 1000 + p) AS a FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY a) AS r FROM f),
n AS (SELECT aid, name || CASE WHEN r > 1 THEN '(' || (r - 1) || ')' ELSE '' END AS label FROM r),
d AS (SELECT DISTINCT id, p, aid FROM l)
SELECT o_orderkey AS id, string_agg(label, ';' ORDER BY p) AS authors FROM orders LEFT JOIN d ON id = o_orderkey LEFT JOIN n USING (aid) GROUP BY 1""")
def _(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = F.array_sort(F.collect_set(F.struct("s_name", "n_name")))
    docs = lines.groupBy(F.col("l_orderkey").alias("id")).agg(pairs.alias("p")).select(
        "id", F.col("p.n_name").alias("authors"), F.col("p.s_name").alias("authors_id"))
    docs = corpus(spark, sf).join(docs, "id", "left")
    return C.disambiguate_authors(docs).select("id", F.array_join("authors", ";").alias("authors"))


@query("clean_title", f"SELECT page_id, trim({_TITLE}, ' ') AS title FROM pages")
def _(spark, sf):
    return titles(spark, sf).select("page_id", C.clean_title(F.concat("title", F.lit(" [Titre]"))).alias("title"))


@query("strip_copyright", "SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' ' ELSE split_part(text, '©', 1) END AS text FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    noticed = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" © "), "source")).otherwise(F.col("text"))
    return d.select("doc_id", C.strip_copyright(noticed).alias("text"))


@query("clean_keywords", with_views("docs", "kw") + """
SELECT docs.id, string_agg(lower(term), ';' ORDER BY lower(term)) AS author_keywords FROM docs LEFT JOIN kw USING (id) GROUP BY docs.id""")
def _(spark, sf):
    c = corpus(spark, sf, "author_keywords").withColumn(
        "author_keywords", F.transform("author_keywords", lambda x: F.concat(F.lit("  "), F.upper(x))))
    return C.clean_keywords(c).select("id", F.array_join("author_keywords", ";").alias("author_keywords"))


@query("clean_sources", "SELECT c_custkey AS id, c_mktsegment || 'J' AS abb_source_title, c_name || '. ' || c_mktsegment AS source_title FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(".J.")).alias("abb_source_title"),
        F.concat("c_name", F.lit("; "), "c_mktsegment").alias("source_title"))
    return C.clean_sources(c)


def nation_countries(spark, sf):
    return table(spark, sf, "nation").select(
        F.lower("n_name").alias("name"), F.lower("n_name").alias("country"), F.format_string("N%02d", "n_nationkey").alias("code"))


@query("extract_country", """WITH a AS (SELECT s_suppkey AS k, n_nationkey AS nk, lower(n_name) AS n, CASE s_suppkey % 3 WHEN 0 THEN 'University of ' || s_name || ', ' || n_name
  WHEN 1 THEN 'Bank of ' || n_name || ' / ' || s_name ELSE s_name END AS affiliation FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT affiliation, CASE WHEN k % 3 < 2 THEN n END AS country, CASE WHEN k % 3 < 2 THEN 'N' || lpad(nk::VARCHAR, 2, '0') END AS code FROM a""")
def _(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.col("s_suppkey") % 3
    place = F.when(kind == 0, F.concat(F.lit("University of "), "s_name", F.lit(", "), "n_name")).when(
        kind == 1, F.concat(F.lit("Bank of "), "n_name", F.lit(" / "), "s_name")).otherwise(F.col("s_name"))
    return C.extract_country(s.select(place.alias("affiliation")), nation_countries(spark, sf))


@query("document_countries", with_views("docs", "co") + """
SELECT docs.id, string_agg(lower(term), ';' ORDER BY term) AS countries FROM docs LEFT JOIN co USING (id) GROUP BY docs.id""")
def _(spark, sf):
    out = C.document_countries(corpus(spark, sf, "affiliations"), nation_countries(spark, sf))
    return out.select("id", F.array_join(F.array_sort("countries"), ";").alias("countries"))


@query("institution_thesaurus", """SELECT DISTINCT 'University of Supplier#' || substr(s_name, 10) || ' N' || lpad(n_nationkey::VARCHAR, 2, '0') AS canonical,
  'dept of supply, university of ' || lower(s_name) || ', ' || lower(n_name) AS variant
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, sf):
    return C.institution_thesaurus(corpus(spark, sf, "affiliations"), nation_countries(spark, sf))[0]


def cited_corpus(spark, sf):
    """Orders with titles, and references that name the title and year of earlier orders."""
    docs = corpus(spark, sf, "title")
    cited = docs.select(F.col("id").alias("cited"), F.concat(
        F.lit("Various authors. "), F.upper("title"), F.lit(" (printed), vol. "), F.col("cited") % 7, F.lit(", "), "year").alias("ref"))
    refs = citation_edges(spark, sf).join(cited, "cited").groupBy(F.col("citing").alias("id")).agg(
        F.collect_set("ref").alias("global_references"))
    return docs.join(refs, "id", "left")


@query("citation_pairs", with_views("placed", "edges") + " SELECT citing, cited FROM edges")
def _(spark, sf):
    return C.citation_pairs(cited_corpus(spark, sf))


@query("local_references", with_views("docs", "placed", "edges") + """, h AS (SELECT id, year || '-' || (row_number() OVER (PARTITION BY year ORDER BY id) - 1) AS h FROM docs),
r AS (SELECT citing AS id, string_agg(h, ';' ORDER BY h) AS refs FROM edges JOIN h ON h.id = cited GROUP BY 1), c AS (SELECT cited AS id, count(*) AS n FROM edges GROUP BY 1)
SELECT id, refs AS local_references, coalesce(n, 0) AS local_citations FROM docs LEFT JOIN r USING (id) LEFT JOIN c USING (id)""")
def _(spark, sf):
    from corpuscope.operators.windows import historiograph_id
    out = C.local_references(historiograph_id(cited_corpus(spark, sf)))
    return out.select("id", F.array_join("local_references", ";").alias("local_references"), "local_citations")


@query("import_corpus")
def _(spark, sf):
    c = cited_corpus(spark, sf).join(corpus(
        spark, sf, "authors", "affiliations", "author_keywords", "index_keywords", "source_title", "document_type"
    ).drop("year", "global_citations"), "id")
    out = C.import_corpus(with_abstracts(spark, sf, c), nation_countries(spark, sf))
    return out.select("id", "year", "historiograph_id", "num_authors", "bradford_law_zone", "local_citations",
                      F.array_join("institutions", ";").alias("institutions"), "country_1st_author",
                      F.array_join("keywords_cleaned", ";").alias("keywords_cleaned"),
                      F.array_join("abstract_keywords", ";").alias("abstract_keywords"))
