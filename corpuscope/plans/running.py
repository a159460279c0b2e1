"""Running totals and ordinals over groups of any size.

A plain window sorts each group in one task; here the rows are range partitioned
by (group, order), totals per range are carried forward, and windows only span
one range of one group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialise


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running aggregates in ``order`` within ``group``.

    ``sums`` maps new column names to summed expressions; ``latest`` maps new
    names to expressions whose maximum so far is kept (a struct led by the order
    gives "last value").  ``order`` has to be unique within the group.
    """
    sums, latest = dict(sums or {}), dict(latest or {})
    group = list(group)
    values = {name: expr for name, expr in [*sums.items(), *latest.items()]}
    ranged = df.withColumns({f"_v_{name}": expr for name, expr in values.items()})
    ranged = ranged.repartitionByRange(_partitions(df), *group, *order).withColumn(
        "_range", F.spark_partition_id()
    )
    ranged = materialise(ranged)

    # One row per (group, range); only groups cut by a range border carry
    # something forward, which is fewer rows than there are ranges.
    totals = ranged.groupBy(*group, "_range").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums],
        *[F.max(f"_v_{name}").alias(f"_t_{name}") for name in latest],
    )
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_range").alias("_r"),
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[F.sum(f"_t_{name}").over(before).alias(f"_c_{name}") for name in sums],
        *[F.max(f"_t_{name}").over(before).alias(f"_c_{name}") for name in latest],
    ).where("_earlier > 0").drop("_earlier")

    match = F.col("_range") == F.col("_r")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = ranged.join(F.broadcast(carried), match, "left")
    within = (
        Window.partitionBy(*group, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = {}
    for name in sums:
        zero = F.lit(0).cast(ranged.schema[f"_v_{name}"].dataType)
        out[name] = F.sum(f"_v_{name}").over(within) + F.coalesce(F.col(f"_c_{name}"), zero)
    for name in latest:
        out[name] = F.greatest(F.max(f"_v_{name}").over(within), F.col(f"_c_{name}"))
    return joined.select(*df.columns, *[expr.alias(name) for name, expr in out.items()])


def ordinal(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row in its group as ``name``."""
    return running(df, group, order, sums={name: F.lit(1).cast("bigint")})
