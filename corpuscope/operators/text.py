"""Keyword matching, concordances, spelling and words of text columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.items import doc_terms, items
from ..functions.stem import stem_key
from ..functions.text_keys import normalised, remove_accents, words
from ..plans.containment import contained_patterns, token_runs
from ..plans.lineage import materialise
from ..plans.skew import skew_join

TOKEN = r"[\p{L}\p{N}_\-]+"
#: Words, and every other visible character as a token of its own.
TOKEN_OR_MARK = TOKEN + r"|[^\s\p{L}\p{N}_\-]"


def java_quote(text: str) -> str:
    """``text`` as a literal regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def regex(pattern: str, ignore_case: bool = True, full_match: bool = False, use_re: bool = False) -> str:
    """Regular expression of a user pattern, with Unicode words and case."""
    body = pattern if use_re else java_quote(pattern)
    if full_match:
        body = f"^(?:{body})$"
    return f"(?{'iuU' if ignore_case else 'U'}:{body})"


def _matches(pattern: str):
    return lambda text: F.rlike(text, F.lit(pattern))


def _first_match(pattern: str):
    return lambda text: F.regexp_extract(text, pattern, 0)


@dataclass(frozen=True)
class KeywordSet:
    """A short list of keywords or regular expressions; long lists are tables."""

    keywords: Sequence[str]
    ignore_case: bool = True
    full_match: bool = False
    use_re: bool = False
    _sorted: list[str] = field(init=False, repr=False)

    def __post_init__(self):
        clean = sorted({k.strip() for k in self.keywords if k and k.strip()})
        object.__setattr__(self, "_sorted", clean)

    def __len__(self) -> int:
        return len(self._sorted)

    def __add__(self, other: KeywordSet) -> KeywordSet:
        return KeywordSet(
            [*self._sorted, *other._sorted],
            self.ignore_case or other.ignore_case,
            self.full_match or other.full_match,
            self.use_re or other.use_re,
        )

    def patterns(self) -> list[str]:
        return [regex(k, self.ignore_case, self.full_match, self.use_re) for k in self._sorted]

    def extract(self, c: Column, sep: str = ";") -> Column:
        """Sorted unique matches, ``sep``-joined; the first match per keyword and ``;``-item."""
        parts = F.split(c, ";", -1)
        hits = [F.transform(F.filter(parts, _matches(r)), _first_match(r)) for r in self.patterns()]
        found = F.array_sort(F.array_distinct(F.concat(*hits)))
        return F.when(F.size(found) > 0, F.array_join(found, sep))

    def contains(self, c: Column) -> Column:
        parts = F.split(c, ";", -1)
        found = [F.exists(parts, _matches(r)) for r in self.patterns()]
        return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))

    def remove(self, c: Column) -> Column:
        return reduce(lambda x, r: F.regexp_replace(x, r, ""), self.patterns(), c)

    def _by_first_pattern(self, c: Column, cut) -> Column:
        return F.coalesce(*[F.when(F.rlike(c, F.lit(r)), cut(r)) for r in self.patterns()])

    def after_first(self, c: Column) -> Column:
        """From the first match to the end."""
        return self._by_first_pattern(
            c, lambda r: F.substring(c, F.length(F.split(c, r, -1)[0]) + 1, F.length(c))
        )

    def after_last(self, c: Column) -> Column:
        """From the last match to the end."""
        return self._by_first_pattern(
            c,
            lambda r: F.concat(
                F.element_at(F.regexp_extract_all(c, F.lit(r), F.lit(0)), -1),
                F.element_at(F.split(c, r, -1), -1),
            ),
        )

    def until_first(self, c: Column) -> Column:
        """From the start to the end of the first match."""
        return self._by_first_pattern(
            c, lambda r: F.concat(F.split(c, r, -1)[0], F.regexp_extract(c, r, 0))
        )

    def until_last(self, c: Column) -> Column:
        """From the start to the end of the last match."""
        return self._by_first_pattern(
            c,
            lambda r: F.substring(
                c, F.lit(1), F.length(c) - F.length(F.element_at(F.split(c, r, -1), -1))
            ),
        )

    def nearby(self, c: Column, n: int = 0) -> Column:
        """Phrases with a match and the ``n`` before and after, each side only when complete."""
        phrases = F.filter(F.transform(F.split(c, r"\.", -1), lambda x: F.trim(x)), lambda p: p != "")
        none = F.slice(phrases, 1, 0)

        def around(p: Column, i: Column) -> Column:
            hits = reduce(lambda a, b: a + b, [F.rlike(p, F.lit(r)).cast("int") for r in self.patterns()])
            if n == 0:
                return F.array_repeat(p, hits)
            left = F.when(i >= n, F.slice(phrases, F.greatest(i - n + 1, F.lit(1)), n)).otherwise(none)
            right = F.when(i + n < F.size(phrases), F.slice(phrases, i + 2, n)).otherwise(none)
            return F.flatten(F.array_repeat(F.concat(left, F.array(p), right), hits))

        found = F.flatten(F.transform(phrases, around))
        return F.when(F.size(found) > 0, F.concat(F.array_join(found, ". "), F.lit(".")))


def extract_keywords(df: DataFrame, col: str, keywords: KeywordSet, new: str) -> DataFrame:
    return df.withColumn(new, keywords.extract(F.col(col)))


def contains_keywords(df: DataFrame, col: str, keywords: KeywordSet, new: str) -> DataFrame:
    return df.withColumn(new, keywords.contains(F.col(col)))


def remove_keywords(df: DataFrame, col: str, keywords: KeywordSet, new: str) -> DataFrame:
    return df.withColumn(new, keywords.remove(F.col(col)))


def transform_keywords(terms: DataFrame, keywords: KeywordSet) -> DataFrame:
    """New vocabulary: what the keywords match in the terms of another, as ``(term)``."""
    return (
        terms.select(keywords.extract(F.trim("term")).alias("term"))
        .where("term IS NOT NULL")
        .distinct()
    )


def keyword_vocabulary(df: DataFrame, col: str) -> DataFrame:
    """Distinct trimmed keywords of a column, the table form of a keyword set."""
    return doc_terms(df, col).select("term").distinct()


def extract_keywords_from_table(
    df: DataFrame, col: str, keywords: DataFrame, ignore_case: bool = True
) -> DataFrame:
    """``(id, term)``: the keywords of a table of any size that occur in a text column."""
    fold = F.lower if ignore_case else (lambda c: c)
    texts = df.select("id", fold(F.col(col)).alias("text"))
    folded = keywords.select("term", fold(F.col("term")).alias("pattern"))
    found = contained_patterns(texts, folded, ["id"])
    return skew_join(found, folded, "pattern").select("id", "term").distinct()


def extract_nearby(df: DataFrame, col: str, keywords: KeywordSet, n: int, new: str) -> DataFrame:
    return df.withColumn(new, keywords.nearby(F.col(col), n))


def sentences(df: DataFrame, col: str) -> DataFrame:
    """Elementary contexts ``(id, pos, sentence)``: a text cut at ``. : ? !``."""
    parts = F.filter(F.transform(F.split(col, "[.:?!]", -1), _trimmed), lambda s: s != "")
    return df.select("id", F.posexplode(parts).alias("pos", "sentence"))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def neighbourhood(df: DataFrame, col: str, n: int) -> DataFrame:
    """``(id, pos, sentence, context)``: each sentence with up to ``n`` around it."""
    parts = F.filter(F.transform(F.split(col, "[.:?!]", -1), _trimmed), lambda s: s != "")
    rows = df.select("id", parts.alias("_all")).select(
        "id", "_all", F.posexplode("_all").alias("pos", "sentence")
    )
    start = F.greatest(F.col("pos") - n, F.lit(0))
    return rows.select(
        "id",
        "pos",
        "sentence",
        F.array_join(F.slice("_all", start + 1, F.col("pos") + n - start + 1), ". ").alias("context"),
    )


def concordances(
    df: DataFrame, keywords: Sequence[str], text: str = "abstract", limit: int = 50
) -> DataFrame:
    """Sentences holding all the keywords, per document, most cited documents first."""
    parts = F.split(F.col(text), r"\. ", -1)
    hits = F.filter(
        parts,
        lambda s: reduce(lambda a, b: a & b, [F.lower(s).contains(k.lower()) for k in keywords]),
    )
    return (
        df.withColumn("concordance", F.concat(F.array_join(hits, ". "), F.lit(".")))
        .where(F.size(hits) > 0)
        .orderBy(F.col("global_citations").desc(), "id")
        .limit(limit)
    )


def co_mentioned(df: DataFrame, col: str, keyword: str, text: str = "abstract") -> DataFrame:
    """Keywords of the corpus that share a sentence with ``keyword``, case aside."""
    lines = df.select(F.explode(F.split(F.lower(F.col(text)), r"\. ", -1)).alias("text")).where(
        F.col("text").contains(keyword.lower())
    )
    terms = doc_terms(df, col).select("term", F.lower("term").alias("pattern")).distinct()
    found = contained_patterns(lines, terms.select("pattern"))
    return terms.join(found, "pattern", "left_semi").select("term").distinct()


def mentioned_keywords(df: DataFrame, col: str, text: str = "abstract") -> DataFrame:
    """Keywords that occur in the text of a document they belong to, case aside."""
    return (
        doc_terms(df.withColumn("_text", F.lower(text)), col, ["_text"])
        .where(F.col("_text").contains(F.lower("term")))
        .select("term")
        .distinct()
    )


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN_OR_MARK), F.lit(0))


def _token_grams(df: DataFrame, tokens: str, widths: Sequence[int]) -> DataFrame:
    """``(id, gram)``: runs of adjacent tokens of the wanted widths, each once a text."""
    runs = F.concat(*[token_runs(F.col(tokens), w) for w in widths])
    return df.select("id", F.explode(F.array_distinct(runs)).alias("gram"))


def _keyword_widths(keywords: DataFrame) -> list[int]:
    """Distinct numbers of tokens per keyword: a few small integers."""
    width = F.size(F.split("gram", " ", -1))
    return sorted(r[0] for r in keywords.select(width).distinct().collect())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _unclaimed(tokens: pd.Series, grams: pd.Series) -> pd.Series:
    """Places in ``grams`` of those that get words of their own, longest first, then left to right."""

    def chosen(words, known):
        if words is None or known is None:
            return None
        place = {}
        for i, gram in enumerate(known):
            place.setdefault(gram, i)
        words, hits = list(words), []
        for n in {gram.count(" ") + 1 for gram in place}:
            runs = words if n == 1 else [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            hits += [(-len(gram), gram, i, n) for i, gram in enumerate(runs) if gram in place]
        taken, out = bytearray(len(words)), {}
        for _, gram, i, n in sorted(hits):
            if not any(taken[i : i + n]):
                taken[i : i + n] = b"\1" * n
                out[place[gram]] = None
        return list(out)

    return pd.Series([chosen(t, g) for t, g in zip(tokens, grams, strict=True)], dtype=object)


def keywords_in_abstract(
    df: DataFrame,
    text: str = "abstract",
    author: str = "author_keywords",
    index: str = "index_keywords",
) -> DataFrame:
    """Add the keywords of the corpus found in each text, in three sorted lists.

    Longer keywords claim their words first, so ``net`` inside a matched
    ``neural net`` is not reported unless it also occurs by itself.
    """
    tokenised = F.array_join(
        F.regexp_extract_all(F.lower("term"), F.lit(TOKEN_OR_MARK), F.lit(0)), " "
    )
    vocab = (
        doc_terms(df, author)
        .select("term", tokenised.alias("gram"), F.lit(True).alias("a"), F.lit(False).alias("i"))
        .union(
            doc_terms(df, index).select(
                "term", tokenised.alias("gram"), F.lit(False).alias("a"), F.lit(True).alias("i")
            )
        )
        .where("gram <> ''")
        .groupBy("gram", "term")
        .agg(F.bool_or("a").alias("a"), F.bool_or("i").alias("i"))
        # Terms that only differ in case or blanks are found together.
        .groupBy("gram")
        .agg(F.collect_list(F.struct("term", "a", "i")).alias("terms"))
    )
    vocab = materialise(vocab)
    widths = _keyword_widths(vocab)
    out = ["abstract_keywords", "abstract_author_keywords", "abstract_index_keywords"]
    if not widths:
        return df.withColumns({c: F.lit(None).cast("array<string>") for c in out})
    # Each keyword travels once a text; its places are found again in the tokens.
    tokens = df.select("id", _tokens(text).alias("_t"))
    present = (
        skew_join(_token_grams(tokens, "_t", widths), vocab, "gram")
        .groupBy("id")
        .agg(F.collect_list(F.struct("gram", "terms")).alias("_g"))
    )
    # The tokens are made after the join, so that the texts are not shuffled twice over.
    found = df.join(present, "id", "left").withColumn("_t", _tokens(text))
    found = found.withColumn("_free", _unclaimed(F.when(F.col("_g").isNotNull(), F.col("_t")), F.col("_g.gram")))
    found = found.withColumn("_c", F.flatten(F.transform("_free", lambda i: F.get("_g", i)["terms"])))

    def names(keep) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter("_c", keep), lambda c: c["term"])))

    kept = [lambda c: F.lit(True), lambda c: c["a"], lambda c: c["i"]]
    return found.withColumns({c: names(keep) for c, keep in zip(out, kept)}).drop("_t", "_g", "_free", "_c")


@F.pandas_udf(T.StringType())
def _respelled(pieces: pd.Series, british: pd.Series, american: pd.Series) -> pd.Series:
    """The pieces of a text put together again, with its British words replaced."""

    def written(words, old, new):
        if words is None or old is None:
            return None
        known = {b: a for b, a in zip(old, new, strict=True) if a is not None}
        return "".join([known.get(w, w) for w in words])

    return pd.Series([written(*row) for row in zip(pieces, british, american, strict=True)], dtype=object)


def to_american(df: DataFrame, cols: Sequence[str], spelling: DataFrame) -> DataFrame:
    """Replace whole British words by the American ones of ``spelling`` (british, american).

    Each document receives only the pairs that concern it, and is rewritten in place.
    """
    pieces = {c: F.regexp_extract_all(F.col(c), F.lit(r"(?U)\w+|\W+"), F.lit(0)) for c in cols}
    empty = F.array().cast("array<string>")
    used = df.select(
        "id",
        F.explode(
            F.array_distinct(F.concat(*[F.coalesce(p, empty) for p in pieces.values()]))
        ).alias("british"),
    )
    # A written table of few pairs meets the words where they are.
    pairs = materialise(spelling.select("british", "american").dropDuplicates(["british"]))
    per_doc = (
        skew_join(used, pairs, "british")
        .groupBy("id")
        .agg(F.collect_set(F.struct("british", "american")).alias("_pairs"))
    )
    joined = df.join(per_doc, "id", "left")
    known = F.col("_pairs").isNotNull()
    return joined.withColumns(
        {
            c: F.when(known & F.col(c).isNotNull(), _respelled(F.when(known, p), "_pairs.british", "_pairs.american"))
            .otherwise(F.col(c))
            for c, p in pieces.items()
        }
    ).drop("_pairs")


def extract_words(
    df: DataFrame,
    col: str,
    keywords: DataFrame | None = None,
    phrases: Sequence[str] = (),
    new: str = "words",
) -> DataFrame:
    """Content words of a text: no stop words or non-letters, and none of ``phrases``.

    Stock phrases depend on the field; a caller reads its list with ``read_terms``.

    Keywords of several words found in the text (table ``(term)``) stay together,
    joined by underscores.
    """
    text = F.regexp_replace(F.lower(F.col(col)), r"[\s+]", " ")
    work = df.withColumn("_text", text)
    if keywords is not None:
        compound = materialise(keywords.select(F.lower("term").alias("gram")).where("gram LIKE '% %'").distinct())
        widths = _keyword_widths(compound)
        if widths:
            grams = _token_grams(work.select("id", _tokens("_text").alias("_t")), "_t", widths)
            hits = skew_join(grams, compound, "gram")
            per_doc = hits.groupBy("id").agg(
                F.transform(
                    F.array_sort(F.collect_set(F.struct((-F.length("gram")).alias("k"), "gram"))),
                    lambda h: h["gram"],
                ).alias("_keep")
            )
            joined = F.aggregate(
                F.coalesce("_keep", F.array().cast("array<string>")),
                F.col("_text"),
                lambda acc, k: F.replace(acc, k, F.translate(k, " -", "__")),
            )
            work = work.join(per_doc, "id", "left").withColumn("_text", joined).drop("_keep")
    if phrases:
        work = work.withColumn(
            "_text", F.regexp_replace("_text", "|".join(java_quote(p) for p in phrases), "")
        )
    tokens = F.filter(
        F.transform(
            F.split(F.replace("_text", F.lit(" - "), F.lit(" ")), r"[\s.,;:!?()\"]+", -1),
            lambda w: F.regexp_replace(w, r"[^\p{L}_\-]", ""),
        ),
        lambda w: w != "",
    )
    work = work.withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>"))).drop("_text")
    remover = StopWordsRemover(
        inputCol="_tokens", outputCol=new, stopWords=StopWordsRemover.loadDefaultStopWords("english")
    )
    return remover.transform(work).drop("_tokens")


def collocations(df: DataFrame, col: str, n: int = 20, min_count: int = 2) -> DataFrame:
    """Adjacent word pairs of the corpus by log-likelihood ratio, with PMI.

    Stop words and words of one or two letters take no part in a pair.
    """
    tokens = df.select(
        F.regexp_extract_all(F.lower(F.col(col)), F.lit(TOKEN), F.lit(0)).alias("_t")
    ).where(F.size("_t") > 0)
    singles = tokens.select(F.explode("_t").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )
    adjacent = F.arrays_zip(
        F.slice("_t", F.lit(1), F.size("_t") - 1).alias("w1"), F.slice("_t", F.lit(2), F.size("_t")).alias("w2")
    )
    pairs = (
        tokens.where(F.size("_t") > 1)
        .select(F.inline(adjacent).alias("w1", "w2"))
        .groupBy("w1", "w2")
        .agg(F.count(F.lit(1)).alias("n12"))
        .where(F.col("n12") >= min_count)
    )
    stop = StopWordsRemover.loadDefaultStopWords("english")
    for w in ("w1", "w2"):
        pairs = pairs.where((F.length(w) > 2) & ~F.col(w).isin(stop))
        pairs = skew_join(pairs, singles.select(F.col("word").alias(w), F.col("n").alias(f"n_{w}")), w)
    total = singles.agg(F.sum("n")).scalar()
    o = {"11": F.col("n12"), "10": F.col("n_w1") - F.col("n12"), "01": F.col("n_w2") - F.col("n12")}
    scored = pairs.withColumn("_n", total)
    o["00"] = F.col("_n") - F.col("n_w1") - F.col("n_w2") + F.col("n12")
    row = {"1": F.col("n_w1"), "0": F.col("_n") - F.col("n_w1")}
    col_ = {"1": F.col("n_w2"), "0": F.col("_n") - F.col("n_w2")}

    def part(cell: str) -> Column:
        expected = row[cell[0]].cast("double") * col_[cell[1]] / F.col("_n")
        return F.when(o[cell] > 0, o[cell] * F.ln(o[cell] / expected)).otherwise(0.0)

    llr = 2 * (part("11") + part("10") + part("01") + part("00"))
    pmi = F.log2(F.col("n12").cast("double") * F.col("_n") / F.col("n_w1") / F.col("n_w2"))
    return (
        scored.select("w1", "w2", F.col("n12").alias("num_pairs"), llr.alias("llr"), pmi.alias("pmi"))
        .orderBy(F.col("llr").desc(), "w1", "w2")
        .limit(n)
    )


def highlight(c: Column, keywords: Sequence[str]) -> Column:
    """Write the keywords of a short list in capitals, longest first."""
    ordered = sorted(set(keywords), key=lambda k: (-len(k), k))
    return reduce(
        lambda x, k: F.regexp_replace(x, regex(k), k.upper().replace("\\", "\\\\").replace("$", "\\$")),
        ordered,
        c,
    )


def complete_keywords(
    df: DataFrame, col: str = "author_keywords", texts: Sequence[str] = ("title", "abstract")
) -> DataFrame:
    """Give documents without keywords those of the corpus found in their texts."""
    missing = df.where(F.col(col).isNull()).select("id", F.concat_ws(" ", *texts).alias("_text"))
    vocab = doc_terms(df, col).select("term").distinct()
    found = (
        extract_keywords_from_table(missing, "_text", vocab)
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("term")).alias("_found"))
    )
    return (
        df.join(found, "id", "left")
        .withColumn(col, F.coalesce(F.col(col), F.col("_found")))
        .drop("_found")
    )


def find_terms(
    df: DataFrame,
    col: str,
    patterns: Sequence[str],
    ignore_case: bool = True,
    full_match: bool = False,
    use_re: bool = False,
) -> DataFrame:
    """Distinct terms of a column that match any of the patterns."""
    matches = reduce(
        lambda a, b: a | b,
        [F.rlike("term", F.lit(regex(p, ignore_case, full_match, use_re))) for p in patterns],
    )
    return doc_terms(df, col).where(matches).select("term").distinct()


def _stems(terms: DataFrame, kind: str) -> DataFrame:
    plain = F.lower(remove_accents(F.col("term")))
    return terms.select("term", stem_key(plain, kind).alias("stems"))


def find_terms_by_stem(
    df: DataFrame, col: str, query: str, mode: str = "and", kind: str = "porter"
) -> DataFrame:
    """Distinct terms sharing stems with ``query``, Porter's or Snowball's.

    ``and``: the sorted stems of the query occur in the sorted stems of the term;
    ``or``: any stem of the query occurs in any stem of the term.
    """
    spark = df.sparkSession
    terms = _stems(doc_terms(df, col).select("term").distinct(), kind)
    wanted = _stems(spark.createDataFrame([(query,)], "term string"), kind).select("stems").scalar()
    terms = terms.withColumn("_q", wanted)
    if mode == "and":
        return terms.where(F.contains("stems", "_q")).select("term")
    return terms.where(
        F.exists(
            F.split("stems", " "),
            lambda t: F.exists(F.split("_q", " "), lambda q: F.contains(t, q)),
        )
    ).select("term")


def nest_terms(terms: DataFrame, max_distance: int | None = None, stem: bool = False) -> DataFrame:
    """``(parent, term)``: the longest other term whose words all occur in the term.

    ``max_distance`` bounds the difference in number of words.  Each term has one
    parent; terms nested in nothing are left out.  A term is compared only with
    those that hold its rarest word.
    """
    base = terms.select("term").distinct()
    key = stem_key(F.col("term")) if stem else normalised(F.col("term"))
    base = base.select("term", F.array_sort(F.array_distinct(words(key))).alias("w")).where(
        F.size("w") > 0
    )
    tokens = base.select("term", F.explode("w").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_f"))
    rarest = (
        skew_join(tokens, frequency, "token")
        .groupBy("term")
        .agg(F.min_by("token", F.struct("_f", "token")).alias("token"))
    )
    parents = rarest.join(base, "term").select(
        "token", F.col("term").alias("parent"), F.col("w").alias("pw")
    )
    children = base.select("term", "w", F.explode("w").alias("token"))
    pairs = skew_join(children, parents, "token").where(
        (F.col("term") != F.col("parent")) & (F.size(F.array_except("pw", "w")) == 0)
    )
    # Equal word sets nest under the alphabetically first of them.
    pairs = pairs.where((F.size("pw") < F.size("w")) | (F.col("parent") < F.col("term")))
    if max_distance is not None:
        pairs = pairs.where(F.size("w") - F.size("pw") <= max_distance)
    return pairs.groupBy("term").agg(
        F.min_by("parent", F.struct(-F.size("pw"), F.col("parent"))).alias("parent")
    ).select("parent", "term")
