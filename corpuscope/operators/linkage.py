"""Single linkage at all levels from one spanning forest.

The strongest links that join everything that hangs together are found once, in
rounds in which each component picks its strongest outgoing link.  The clusters of
any threshold are then components of that forest, which has fewer links than nodes.
Rounds at least halve the components; each ends in a written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import is_empty, materialise
from ..plans.running import running
from ..plans.skew import skew_join
from .graph import connected_components


def _strongest() -> Column:
    """The first link in one strict order: larger values, then smaller ends."""
    return F.min_by(F.struct("a", "b", "value", "u", "v"), F.struct(-F.col("value"), "a", "b"))


def _roots(picked: DataFrame) -> DataFrame:
    """``(c, root)``: components that hang together by the links they picked.

    Each component points along its link.  In a strict order of links exactly one link
    of each group is picked from both sides; its smaller side is the root.  Pointers
    are doubled until they rest, in rounds logarithmic in the longest way.
    """
    pointers = picked.groupBy("a", "b").agg(
        F.first("u").alias("u"), F.first("v").alias("v"), F.collect_list("c").alias("sides")
    ).select(
        F.explode("sides").alias("c"),
        F.when(F.size("sides") == 2, F.least("u", "v")).alias("low"),
        "u",
        "v",
    )
    at = materialise(
        pointers.select(
            "c", F.coalesce("low", F.when(F.col("c") == F.col("u"), F.col("v")).otherwise(F.col("u"))).alias("root")
        )
    )
    while True:
        ahead = at.toDF("root", "next")
        moved = materialise(
            skew_join(at, ahead, "root", hot="detect").select(
                "c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")
            )
        )
        at = moved.select("c", "root")
        if is_empty(moved.where("moved")):
            return at


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``(t1, t2, value)`` with t1 < t2: the maximum spanning forest of weighted links.

    ``edges`` is ``(t1, t2, value)`` in one or both directions; of parallel links the
    largest counts.  Loops and links with a null or NaN value or a null end are left
    out.  Equal values are ordered by the ends, so the forest is unique.  An empty
    table gives an empty forest.
    """
    clean = edges.where("t1 <> t2 AND value IS NOT NULL").where(~F.isnan(F.col("value").cast("double")))
    ends = clean.select(F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b"), "value")
    links = materialise(
        ends.groupBy("a", "b").agg(F.max("value").alias("value")).select("a", "b", "value", F.col("a").alias("u"), F.col("b").alias("v"))
    )
    parts = []
    while not is_empty(links):
        # Both sides vote; partial results are combined before the shuffle, so a hub is cheap.
        sides = links.select(F.explode(F.array("u", "v")).alias("c"), "a", "b", "value", "u", "v")
        picked = materialise(sides.groupBy("c").agg(_strongest().alias("e")).select("c", "e.*"))
        parts.append(picked.select("a", "b", "value").distinct())
        roots = _roots(picked)
        moved = skew_join(links, roots.toDF("u", "ru"), "u", hot="detect")
        moved = materialise(moved.select("a", "b", "value", "ru", "v"))
        moved = skew_join(moved, roots.toDF("v", "rv"), "v", hot="detect").where("ru <> rv")
        # Only the strongest link between two components can be picked later.
        links = materialise(
            moved.select("a", "b", "value", F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .groupBy("u", "v")
            .agg(_strongest().alias("e"))
            .select("e.*")
        )
    forest = links.select("a", "b", "value")
    for part in parts:
        forest = forest.union(part)
    return forest.toDF("t1", "t2", "value")


def linkage_levels(forest: DataFrame, nodes: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``(threshold, node, cluster)``: single-linkage clusters of all thresholds from one forest.

    ``nodes`` has the column ``node``; nodes without links are clusters of their own.  A
    cluster is the smallest of its nodes.  All thresholds run through one set of rounds.
    """
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    joined = forest.select("t1", "t2", "value", levels).where("value >= threshold")
    alone = nodes.where("node IS NOT NULL").select(F.col("node").alias("t1"), F.col("node").alias("t2"), levels)
    both = joined.select("t1", "t2", "threshold").union(alone.select("t1", "t2", "threshold"))
    placed = both.select(F.struct("threshold", "t1").alias("t1"), F.struct("threshold", F.col("t2").alias("t1")).alias("t2"))
    found = connected_components(placed)
    return found.select(
        F.col("node")["threshold"].alias("threshold"), F.col("node")["t1"].alias("node"), F.col("cluster")["t1"].alias("cluster")
    )


def linkage_profile(forest: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(value, merges, clusters)``: how many clusters are left at each value of the forest.

    One row for each distinct value at which clusters merge; ``clusters`` counts those of
    single linkage at that threshold, over all nodes.
    """
    merges = forest.groupBy("value").agg(F.count(F.lit(1)).alias("merges"))
    total = nodes.where("node IS NOT NULL").select("node").distinct().agg(F.count(F.lit(1)).alias("n"))
    table = running(
        merges.withColumn("_all", F.lit(0)), ["_all"], [F.col("value").desc()], sums={"merged": F.col("merges")}
    )
    return table.select("value", "merges", (total.scalar() - F.col("merged")).alias("clusters"))
