"""Thesauri ``(canonical, variant)``: applying, building and editing them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.items import doc_terms, items
from ..functions.stem import stem_key
from ..functions.text_keys import fingerprint, one_gram, two_gram
from ..plans.containment import containment_join
from ..plans.skew import skew_join
from .sets import new_terms
from .text import regex, to_american

KEYS = {
    "fingerprint": fingerprint,
    "1-gram": one_gram,
    "2-gram": two_gram,
    "porter": stem_key,
    "snowball": partial(stem_key, kind="snowball"),
}
#: Most entries a thesaurus of regular expressions may have.
MAX_EXPRESSIONS = 2000


def apply_thesaurus(
    df: DataFrame, col: str, th: DataFrame, strict: bool = False, new: str | None = None
) -> DataFrame:
    """Replace each item of a column by its canonical term, in place.

    ``strict`` drops items the thesaurus does not know.
    """
    new = new or col
    lookup = th.groupBy(F.col("variant").alias("_item")).agg(F.min("canonical").alias("_canonical"))
    placed = df.select("id", F.posexplode(items(df, col)).alias("_pos", "_item"))
    mapped = skew_join(placed, lookup, "_item", "inner" if strict else "left")
    term = F.coalesce("_canonical", "_item")
    cells = mapped.groupBy("id").agg(
        F.array_distinct(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_pos", term.alias("t")))), lambda s: s["t"]
            )
        ).alias("_cell")
    )
    return df.join(cells, "id", "left").withColumn(new, F.col("_cell")).drop("_cell")


def _ranked(th: DataFrame) -> DataFrame:
    """Thesaurus with a ``rank``: its own, or the alphabetical order of its entries."""
    rank = F.col("rank") if "rank" in th.columns else F.lit(0)
    return th.select(F.struct(rank.alias("r"), "canonical", "variant").alias("rank"), "canonical", "variant")


def _regex_entries(th: DataFrame) -> list:
    """A thesaurus of regular expressions is written by hand; its entries become literals."""
    entries = _ranked(th).orderBy("rank").limit(MAX_EXPRESSIONS + 1).collect()
    if len(entries) > MAX_EXPRESSIONS:
        raise ValueError(f"a thesaurus holds at most {MAX_EXPRESSIONS} regular expressions")
    return entries


def _matches(
    values: DataFrame, th: DataFrame, ignore_case: bool, full_match: bool
) -> DataFrame:
    """``(value, canonical, variant, rank)`` for literal patterns found in distinct values."""
    fold = F.lower if ignore_case else (lambda c: c)
    entries = _ranked(th).withColumn("pattern", fold(F.col("variant")))
    texts = values.select("value", fold(F.col("value")).alias("text"))
    if full_match:
        return skew_join(texts, entries.withColumnRenamed("pattern", "text"), "text")
    pairs = containment_join(texts, entries)
    return skew_join(skew_join(texts, pairs, "text"), entries, "pattern")


def apply_thesaurus_patterns(
    df: DataFrame,
    col: str,
    th: DataFrame,
    ignore_case: bool = True,
    full_match: bool = False,
    use_re: bool = False,
    new: str | None = None,
) -> DataFrame:
    """Replace each value by the first canonical term one of whose patterns matches it.

    The order of entries is ``rank`` when the thesaurus has that column, else alphabetical.
    """
    new = new or col
    value = F.trim(F.col(col))
    if use_re:
        first = F.coalesce(
            *[
                F.when(F.rlike(value, F.lit(regex(e["variant"], ignore_case, full_match, True))), e["canonical"])
                for e in _regex_entries(th)
            ],
            value,
        )
        return df.withColumn(new, F.when(F.col(col).isNotNull(), first))
    values = df.select(value.alias("value")).where("value IS NOT NULL").distinct()
    best = (
        _matches(values, th, ignore_case, full_match)
        .groupBy("value")
        .agg(F.min_by("canonical", "rank").alias("_canonical"))
    )
    joined = skew_join(df.withColumn("value", value), best, "value", "left")
    return joined.withColumn(new, F.coalesce("_canonical", "value")).drop("value", "_canonical")


def find_and_replace(
    df: DataFrame,
    col: str,
    th: DataFrame,
    ignore_case: bool = True,
    full_match: bool = False,
    use_re: bool = False,
    new: str | None = None,
) -> DataFrame:
    """Replace the matched part of each value by the canonical term of the first pattern that changes it."""
    new = new or col
    value = F.trim(F.col(col))
    if use_re:
        tries = []
        for e in _regex_entries(th):
            changed = F.regexp_replace(
                value, regex(e["variant"], ignore_case, full_match, True), F.lit(e["canonical"])
            )
            tries.append(F.when(changed != value, changed))
        return df.withColumn(new, F.coalesce(*tries, value))
    values = df.select(value.alias("value")).where("value IS NOT NULL").distinct()
    flag = F.lit("(?iu)" if ignore_case else "")
    quoted = F.concat(flag, F.lit("\\Q"), F.replace("variant", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    literal = F.replace(
        F.replace("canonical", F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")
    )
    best = (
        _matches(values, th, ignore_case, full_match)
        .withColumn("_changed", F.regexp_replace("value", quoted, literal))
        .where("_changed <> value")
        .groupBy("value")
        .agg(F.min_by("_changed", "rank").alias("_changed"))
    )
    joined = skew_join(df.withColumn("value", value), best, "value", "left")
    return joined.withColumn(new, F.coalesce("_changed", "value")).drop("value", "_changed")


def _alternative(c: Column) -> Column:
    """Term without its first bracketed and first parenthesised part, ``&`` spelled out."""

    def squeeze(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    for pattern in (r"^([^\[]*)\[[^\]]*\]", r"^([^(]*)\([^)]*\)"):
        c = F.when(F.rlike(c, F.lit(pattern)), squeeze(F.regexp_replace(c, pattern, "$1"))).otherwise(c)
    return F.replace(F.replace(c, F.lit("&"), F.lit("and")), F.lit(" of "), F.lit(""))


def cluster_terms(
    df: DataFrame,
    col: str,
    key: str = "porter",
    name_strategy: str = "mostfrequent",
    spelling: DataFrame | None = None,
    transformer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Group the terms of a column whose keys collide, as a thesaurus.

    A group is named by its most frequent term in the corpus, its alphabetically
    first, longest or shortest one; a hyphenated member goes before all of them.
    ``spelling`` (british, american) is applied before the key is taken.
    """
    terms = doc_terms(df, col).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return _cluster(terms, key, name_strategy, spelling, transformer)


def _cluster(terms, key, name_strategy, spelling=None, transformer=None) -> DataFrame:
    base = terms.withColumn("_alt", _alternative(F.col("term")))
    if spelling is not None:
        base = to_american(base.withColumn("id", F.col("term")), ["_alt"], spelling).drop("id")
    keyed = base.select("term", "n", KEYS[key](F.col("_alt")).alias("key"))
    order = {
        "mostfrequent": F.struct(-F.col("n"), F.col("term")),
        "alphabetical": F.struct("term"),
        "longest": F.struct(-F.length("term"), F.col("term")),
        "shortest": F.struct(F.length("term"), F.col("term")),
    }[name_strategy]
    hyphen = F.min(F.when(F.col("term").contains("-"), F.col("term")))
    name = F.coalesce(hyphen, F.min_by("term", order))
    if transformer is not None:
        name = F.when(F.count(F.lit(1)) > 1, transformer(name)).otherwise(name)
    names = keyed.groupBy("key").agg(name.alias("canonical"))
    return skew_join(keyed, names, "key").select("canonical", F.col("term").alias("variant"))


def keywords_thesaurus(
    df: DataFrame,
    cols: Sequence[str] = ("author_keywords", "index_keywords"),
    existing: DataFrame | None = None,
    key: str = "porter",
    name_strategy: str = "mostfrequent",
    spelling: DataFrame | None = None,
) -> DataFrame:
    """Thesaurus of the keywords of a corpus; entries of an existing thesaurus win.

    Quotes and long dashes are dropped and words of one or two letters left out.
    """
    tables = [doc_terms(df, c) for c in cols]
    words = tables[0]
    for t in tables[1:]:
        words = words.union(t)
    clean = F.translate("term", "\"—“”", "")
    clean = F.when(clean.startswith("-"), F.replace(clean, F.lit("-"), F.lit(""))).otherwise(clean)
    terms = (
        words.where(F.length("term") > 2)
        .select(clean.alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if existing is not None:
        fresh = new_terms(terms, existing)
        terms = terms.join(fresh, "term", "left_semi")
    built = _cluster(terms, key, name_strategy, spelling)
    return built if existing is None else built.unionByName(existing.select("canonical", "variant"))


def apply_keywords_thesaurus(df: DataFrame, th: DataFrame) -> DataFrame:
    """Add a ``_cleaned`` copy of each keyword column, and the merged ``keywords`` columns."""
    from ..functions.items import merge_columns

    cols = [
        "author_keywords",
        "index_keywords",
        "title_keywords",
        "abstract_keywords",
        "abstract_author_keywords",
        "abstract_index_keywords",
    ]
    present = [c for c in cols if c in df.columns]
    for c in present:
        df = apply_thesaurus(df, c, th, new=f"{c}_cleaned")
    if {"author_keywords", "index_keywords"} <= set(present):
        df = merge_columns(df, ["author_keywords", "index_keywords"], "keywords")
        df = merge_columns(df, ["author_keywords_cleaned", "index_keywords_cleaned"], "keywords_cleaned")
    return df


def apply_institutions_thesaurus(df: DataFrame, th: DataFrame) -> DataFrame:
    """Add ``institutions`` (known ones only) and the institution of the first author."""
    from ..functions.items import first_item

    lower = df.withColumn("_aff", F.transform(items(df, "affiliations"), F.lower))
    out = apply_thesaurus(lower, "_aff", th, strict=True, new="institutions").drop("_aff")
    return out.withColumn("institution_1st_author", first_item(out, "institutions"))


def merge_keys(th: DataFrame, key: str, merged: Sequence[str]) -> DataFrame:
    """Give the variants of the merged keys to ``key``."""
    canonical = F.when(F.col("canonical").isin(list(merged)), key).otherwise(F.col("canonical"))
    return th.withColumn("canonical", canonical).distinct()


def merge_keys_from(th: DataFrame, merges: DataFrame) -> DataFrame:
    """Merge keys by a table ``(canonical, variant)`` whose variants are keys of ``th``."""
    lookup = merges.select(F.col("variant").alias("canonical"), F.col("canonical").alias("_to"))
    joined = skew_join(th, lookup, "canonical", "left")
    return joined.select(F.coalesce("_to", "canonical").alias("canonical"), "variant").distinct()


def pop_key(th: DataFrame, key: str) -> DataFrame:
    return th.where(F.col("canonical") != key)


def change_key(th: DataFrame, current: str, new: str) -> DataFrame:
    return merge_keys(th, new, [current])


def invert(th: DataFrame) -> DataFrame:
    """Variant to canonical; a variant of several keys takes the last one."""
    return th.groupBy("variant").agg(F.max("canonical").alias("canonical"))


def find_keys(
    th: DataFrame,
    patterns: Sequence[str],
    ignore_case: bool = True,
    full_match: bool = False,
    use_re: bool = False,
) -> DataFrame:
    """Keys with a variant that matches any of the patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.rlike("variant", F.lit(regex(p, ignore_case, full_match, use_re)))
    return th.where(hit).select("canonical").distinct()
