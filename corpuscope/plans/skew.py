"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with more than 1/WAYS of all rows is hot, so there are fewer than WAYS hot keys.
WAYS = 200
#: A key with fewer rows than this fits any task and is not split.
ROWS_PER_TASK = 100_000


def hot_keys(df: DataFrame, on: Sequence[str], ways: int = WAYS) -> DataFrame | None:
    """Keys holding more than ``1/ways`` of the rows, with the number of salts each needs.

    Fewer than ``ways`` rows by construction, whatever the size of ``df``; None
    when no key is hot.  Partial counts are combined before they are shuffled.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    rows = (
        counts.where((F.col("_n") * ways > total) & (F.col("_n") > ROWS_PER_TASK))
        .select(*on, F.ceil(F.col("_n") * ways / total).cast("int").alias("_salts"))
        .collect()
    )
    if not rows:
        return None
    fields = [T.StructField(k, df.schema[k].dataType) for k in on]
    schema = T.StructType([*fields, T.StructField("_salts", T.IntegerType())])
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    ways: int = WAYS,
    hot: DataFrame | str | None = None,
    either: bool = False,
) -> DataFrame:
    """Join ``left`` to ``right`` splitting the hot keys of ``left`` over several tasks.

    ``how`` is inner, left, left_semi or left_anti.  By default this is a plain join:
    adaptive execution splits the large partitions of hot keys of these kinds of join,
    and turns it into a broadcast when a side is small.  Given the result of
    :func:`hot_keys` as ``hot`` (or "detect", which runs ``left`` to find them, so it
    should be a written table), the rows of a hot key are spread over salts on the left
    and the matching right rows are repeated once per salt.  Rows with a NULL key match
    nothing and are spread when they are many.  With ``either``, "detect" also looks
    for hot keys on the right of an inner join and then splits that side.
    """
    on = [on] if isinstance(on, str) else list(on)
    detect = isinstance(hot, str)
    if detect:
        hot = hot_keys(left, on, ways)
    if hot is None and detect and either and how == "inner":
        hot = hot_keys(right, on, ways)
        if hot is not None:
            left, right = right, left
    if hot is None:
        return left.join(right, on, how)
    any_null = F.lit(False)
    for key in on:
        any_null = any_null | F.col(key).isNull()
    salts = F.when(any_null, ways).otherwise(F.coalesce("_salts", F.lit(1)))
    spread = F.xxhash64(F.spark_partition_id(), *left.columns)
    salted_left = left.join(hot, on, "left").withColumn(
        "_salt", F.pmod(spread, salts).cast("int")
    ).drop("_salts")
    salted_right = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
