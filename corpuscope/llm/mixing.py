"""Mixing sources to target weights by weighted sampling without replacement.

A document's sampling key is exponential with a rate that is its quality weight
(Efraimidis and Spirakis), so that ascending keys draw documents without
replacement, better ones earlier.  Each source takes as many complete epochs as
its target holds, and then the documents first in key order whose running total
of words stays nearest to what is left of the target.

Only DataFrame functions are used.  Running totals are computed over key ranges,
so a source that holds most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.plans.running import running

from .storage import stored

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the text of ``key`` only."""
    digits = F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 48)


def targets(
    sources: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: int = 3
) -> DataFrame:
    """Targets of sources given as ``(source, source_size)``, one row each.

    Sources in code point order, null last, get the weights in turn.  They share the
    total size by weight; a target stops at ``most_epochs`` times the source's size
    and the excess is shared anew among the others.  At the end each target is the
    smaller of its limit and a common level times its weight, and the level is found
    from sums over the sources in order of limit over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    limited = sources.withColumn("_weight", weight).withColumn(
        "_limit", F.col("source_size") * most_epochs
    )
    order = Window.orderBy((F.col("_limit") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    level = left / F.sum("_weight").over(after)
    # The level is that of the first source, in this order, that its limit does not stop.
    open_level = F.when(F.col("_limit") >= F.col("_level") * F.col("_weight"), F.col("_level"))
    return (
        limited.withColumn("_level", level)
        .withColumn("_level", F.first(open_level, ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ))
        .select(
            "source",
            "source_size",
            F.least(
                F.col("_limit").cast("double"),
                F.coalesce(F.col("_level") * F.col("_weight"), F.col("_limit").cast("double")),
            ).alias("target"),
        )
    )


def mix_sources(
    docs: DataFrame,
    quality: Column | None = None,
    size: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most_epochs: int = 3,
    seed: int = 0,
) -> DataFrame:
    """Words that a mix takes of each document.

    Returns ``doc_id``, ``source``, ``size`` (words of the text), ``source_size``,
    ``target`` (of the source) and ``taken`` (words, repeats counted): a multiple of
    ``size`` up to ``most_epochs``.  ``quality`` is a positive weight per row; null,
    zero, negative and not-a-number weights count as 1.  ``size`` replaces the count
    of words of ``text_col`` where it is known already.

    Null texts have no words and are taken as they are (``taken`` is 0).  Null
    sources form one source.  Repeated rows are sampled each, in an order that does
    not depend on partitions as far as they differ in id or size; rows with a null id
    are ordered as if their id were the empty text.  An empty table gives no rows.
    Other columns are ignored.
    """
    weight = F.lit(1.0) if quality is None else quality.cast("double")
    weight = F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(1.0)
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = -F.log(uniform(F.concat_ws("|", F.lit(str(seed)), text_id))) / weight
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            (word_count(F.col(text_col)) if size is None else size).cast("bigint").alias("size"),
            key.alias("_key"),
        )
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sources, weights, most_epochs)
    # Equal rows need an order of their own to have running totals.
    tie = F.monotonically_increasing_id()
    ordered = running(
        sized.withColumn("_tie", tie),
        ["source"],
        [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_tie")],
        sums={"_through": F.col("size")},
    )
    goals = stored(plan).withColumnRenamed("source", "_source")
    joined = ordered.join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    epochs = F.least(F.coalesce(epochs, F.lit(0)), F.lit(most_epochs))
    rest = F.col("target") - epochs * F.col("source_size")
    middle = F.col("_through") - F.col("size") / 2
    again = F.when((F.col("size") > 0) & (middle <= rest) & (epochs < most_epochs), 1).otherwise(0)
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        ((epochs + again) * F.col("size")).cast("bigint").alias("taken"),
    )
