"""Words one edit apart, by asymmetric q-chunks.

Of two words at distance one the shorter (or either) contributes two disjoint chunks, its
first and its last half; the other contributes its positional grams of that length.  One
edit touches at most one of the chunks.  If it spares the first, this is a gram of the
other word at shift 0; if it spares the last, at the shift by which the lengths differ (0
or 1).  So each word sends two chunks, and for each of the two lengths that a partner can
have only those of its positional grams that a chunk can meet within shift one.  Words that
meet are verified.

Where too many words share a chunk, those are not compared with each other: what is left
of the words behind the chunk still differs by one edit, so it is cut into two chunks
again, and again.  In the end groups differ in one character and are bounded by the
alphabet.  No pair is lost and no group is compared all with all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import is_empty, stored

#: Maximal runs of at least six letters; deleting one never makes a run longer.
RUNS = "[A-Za-zÀ-ÿ]{6,}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of words that may meet at one chunk before the group is divided.
GROUP_PAIRS = 4096


def mistyped(run: Column, doc_id: Column, one_in: int) -> Column:
    """``run`` without one of its code points where the checksum of id and run says so.

    The checksum is the unsigned CRC-32 of ``<doc_id>:<run>`` (a null id is empty); if
    ``one_in`` divides it, code point checksum % length (from 0) leaves.
    """
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("bigint")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def word_counts(
    docs: DataFrame, text: str = "text", least_length: int = 6, least_count: int = 5, one_in: int = 199
) -> DataFrame:
    """``(word, n)``: distinct words of the texts with their occurrences.

    Words are maximal runs of letters up to U+00FF with A-Z lower-cased, after
    :func:`mistyped`; at least ``least_length`` (six or more) code points and
    ``least_count`` occurrences.  Null and empty texts have none; repeated rows count
    as often as they occur; an empty table has no words.
    """
    if least_length < 6:
        raise ValueError("words have six code points or more")
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(RUNS), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(
        mistyped(F.col("run"), F.col("doc_id"), one_in).alias("word")
    )
    return (
        words.where(F.length("word") >= least_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_count)
    )


def _chunks(rest: Column, size: Column, chunk: Column) -> Column:
    """What a word sends: each end of ``rest`` as key, with what is left of it.

    ``size`` is the length of the chunk side's rest, ``chunk`` of its chunks.
    """
    left = F.length(rest) - chunk
    ends = [
        ("first", F.substring(rest, F.lit(1), chunk), F.substring(rest, chunk + 1, left)),
        ("last", F.substring(rest, left + 1, chunk), F.substring(rest, F.lit(1), left)),
    ]
    return F.array(
        *[
            F.struct(F.xxhash64("key", F.lit(end), size, gram).alias("key"), other.alias("rest"))
            for end, gram, other in ends
        ]
    )


def _divide(words: DataFrame) -> DataFrame:
    """The rows of words at the next chunks; ``delta`` is how much longer than the partner."""
    size = F.length("rest") - F.col("delta")
    met = F.explode(_chunks(F.col("rest"), size, F.floor(size / 2).cast("int")))
    return words.select("word", "n", "delta", met.alias("_c")).select(
        "word", "n", "delta", F.col("_c.key").alias("key"), F.col("_c.rest").alias("rest")
    )


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides at their next chunks, written once for the sizes and the join."""
    both = stored(
        _divide(left).withColumn("side", F.lit(0)).unionByName(_divide(right).withColumn("side", F.lit(1)))
    )
    return both.where("side = 0").drop("side"), both.where("side = 1").drop("side")


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of words that share a key and differ by one edit."""
    a = left.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = right.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "delta")
    # Words of one length meet in both roles; one of them is enough.
    once = (F.col("delta") == 1) | (F.col("a") < F.col("b"))
    near = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    return a.join(b, "key").where(once & near).select("a", "n_a", "b", "n_b")


def near_pairs(words: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """``(a, n_a, b, n_b)``: every pair of distinct words at edit distance one, once.

    ``words`` has distinct, non-null ``word`` of two or more code points and ``n``.
    """
    length = F.length("word")
    start = words.select("word", "n", F.col("word").alias("rest"))
    left = start.withColumns({"delta": F.lit(0), "key": F.xxhash64(length)})
    right = start.withColumn("delta", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "key", F.xxhash64(length - F.col("delta"))
    )
    found = []
    while True:
        left, right = _sides(left, right)
        # A rest of one character leaves as many partners as there are letters.
        divisible = left.where(F.length("rest") > 1).groupBy("key").agg(F.count(F.lit(1)).alias("n_l"))
        sizes = divisible.join(right.groupBy("key").agg(F.count(F.lit(1)).alias("n_r")), "key")
        hot = stored(sizes.where(F.col("n_l") * F.col("n_r") > group_pairs).select("key"))
        if is_empty(hot):
            found.append(_met(left, right))
            break
        found.append(_met(left.join(hot, "key", "left_anti"), right))
        left, right = (side.join(hot, "key", "left_semi") for side in (left, right))
    return reduce(DataFrame.unionByName, found).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for every ``(word, form)``: where the forms lead in the end.

    A form has several times the occurrences of its word, so chains are short and have no
    circles; each round doubles the steps taken.
    """
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        step = stored(
            now.join(ahead, F.col("root") == F.col("_at"), "left").select(
                "word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")
            )
        )
        now = step.select("word", "root")
        if is_empty(step.where("moved")):
            return now


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each ``(word, n)``.

    ``form`` is the near word with most occurrences, ties to the smallest in code-point
    order, if it has at least ``factor`` (two or more) times those of the word, else null;
    ``root`` is the last of the forms of forms, the word itself if it has none.
    """
    if factor < 2:
        raise ValueError("factor has to be two or more")
    words = stored(words.select("word", "n"))
    pairs = stored(near_pairs(words))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    # Texts are ordered by their bytes in UTF-8, which is the order of code points.
    best = sides.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("_best"),
    )
    form_n = -F.col("_best.less")
    isform = form_n >= factor * F.col("n")
    judged = stored(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(isform, F.col("_best.near")).alias("form"),
            F.when(isform, form_n).alias("form_n"),
        )
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
