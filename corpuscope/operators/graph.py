"""Communities, components and main paths, in whole components or as iterated joins.

Label propagation and paths run in one task for each block of small components
(``graph_blocks.py``); components beyond the size of a block take rounds of joins.
Each round ends in a written table, so lineage stays short and a lost executor
costs one round.  The adjacency is written once, with the hot nodes found once.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.blocks import by_component, dealt
from ..plans.lineage import bucketed, is_empty, materialise
from ..plans.skew import hot_keys, skew_join
from .graph_blocks import followed, propagated, weighed

#: Passes of label propagation within blocks that are tried first.
FIRST_PASSES = 16
#: With fewer links than this, rounds of joins are as cheap as finding the components.
BLOCKS_FROM = 10_000


def _undirected(edges: DataFrame, weighted: bool) -> DataFrame:
    """``(a, b, w)``: links once each, loops dropped, parallel links summed."""
    w = F.col("value").cast("double") if weighted else F.lit(1.0)
    return edges.where("t1 <> t2").groupBy(
        F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b")
    ).agg(F.sum(w).alias("w") if weighted else F.lit(1.0).alias("w"))


def _both_ways(one: DataFrame) -> DataFrame:
    """``(node, other, w)`` in both directions."""
    return one.select("a", "b", "w").union(one.select("b", "a", "w")).toDF("node", "other", "w")


def _adjacency(edges: DataFrame, weighted: bool) -> DataFrame:
    """``(node, other, w)`` in both directions, loops dropped, parallel links summed."""
    return _both_ways(_undirected(edges, weighted))


class _Blocks:
    """Label propagation within the small components, all of them pass by pass."""

    def __init__(self, placed: DataFrame):
        ends = [F.xxhash64(c).alias(f"h{c}") for c in ("a", "b")]
        self._links = materialise(placed.select("component", "a", "b", *ends))
        self._run(FIRST_PASSES)

    def _run(self, passes: int) -> None:
        fields = [T.StructField(n, self._links.schema["a"].dataType) for n in ("node", "cluster")]
        told = T.StructType.fromDDL("pass int, moved boolean, inside bigint").fields
        self._passes = passes
        self._rows = materialise(
            dealt(self._links).mapInArrow(partial(propagated, passes=passes), T.StructType([*fields, *told]))
        )
        # One row a pass.
        rows = self._rows.where("node IS NULL").groupBy("pass").agg(F.max("moved"), F.sum("inside")).collect()
        self._told = {p: (moved, grown) for p, moved, grown in rows}

    def after(self, p: int) -> tuple[bool, int]:
        """Whether any node moved in pass ``p``, and the number of links within a label after it."""
        while p >= self._passes and self._told.get(self._passes - 1, (False, 0))[0]:
            self._run(2 * self._passes)
        return self._told.get(p, (False, 0))[0], sum(grown for q, (_, grown) in self._told.items() if q <= p)

    def labels(self, p: int) -> DataFrame:
        """Labels after pass ``p``."""
        if any(moved for q, (moved, _) in self._told.items() if q > p):
            self._run(p + 1)
        return self._rows.where("node IS NOT NULL").select("node", "cluster")


def label_propagation(
    edges: DataFrame, max_iter: int | None = None, weighted: bool = False
) -> DataFrame:
    """``(node, cluster)``: each node takes the commonest label of its neighbours.

    Half of the nodes, by hash, move in each round, so that labels settle; ties
    keep the present label, then take the smallest.  Ends when no node of either half
    moves, or when the weight between nodes of one label has not grown for two passes
    over both halves (nodes that only swap labels).  More than ``max_iter`` passes raise.
    """
    if weighted:
        return _propagate(_adjacency(edges, weighted), None, max_iter)
    links = materialise(_undirected(edges, weighted))
    if links.count() < BLOCKS_FROM:
        return _propagate(_both_ways(links), None, max_iter)
    small, rest = by_component(links, "a", "b")
    return _propagate(None if rest is None else _both_ways(rest), _Blocks(small), max_iter)


def _propagate(adjacency: DataFrame | None, blocks: _Blocks | None, max_iter: int | None) -> DataFrame:
    """:func:`label_propagation` over an adjacency by rounds of joins, beside blocks that know their own passes."""
    labels = None
    if adjacency is not None:
        # Links go both ways, so those of a node also name the nodes whose votes it is part of.
        adj = bucketed(adjacency, "node")
        hot_nodes = hot_keys(adj, ["node"])
        hot = None if hot_nodes is None else hot_nodes.withColumnRenamed("node", "other")
        labels = materialise(adj.select("node", F.col("node").alias("cluster")).distinct())
    still, best_weight, stale, changes = False, -1.0, 0, []
    for r in count():
        if max_iter is not None and r >= 2 * max_iter:
            raise RuntimeError(f"labels have not settled in {max_iter} passes")
        at_rest = True
        if labels is not None:
            labels, moved = _vote(adj, labels, changes, r, hot_nodes, hot)
            changes.append(moved)
            at_rest = is_empty(moved)
        if r % 2 == 0:
            still = at_rest
            continue
        block_moved, block_inside = (False, 0) if blocks is None else blocks.after(r // 2)
        if still and at_rest and not block_moved:
            break
        # Every step but simultaneous swaps raises this sum, so it ends the loop.
        inside = 2.0 * block_inside
        if labels is not None:
            ends = skew_join(adj.where("node < other"), labels.toDF("node", "_l"), "node", hot=hot_nodes)
            ends = skew_join(ends, labels.toDF("other", "_m"), "other", hot=hot)
            inside += 2 * float(ends.where("_l = _m").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0])
        stale = 0 if inside > best_weight + 1e-9 else stale + 1
        best_weight = max(best_weight, inside)
        if stale == 2:
            break
    if blocks is None:
        return labels
    found = blocks.labels(r // 2)
    return found if labels is None else found.union(labels)


def _vote(
    adj: DataFrame, labels: DataFrame, changes: list[DataFrame], r: int, hot_nodes: DataFrame | None, hot: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Labels after round ``r`` and the nodes that moved in it."""
    # Another split in every pass, or neighbours of one half could swap for ever.
    side = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
    voting = adj.where(side)
    if r > 1:
        # A node whose neighbours have not moved since it was asked stays where it is.
        # It was asked in the pass before, at most three rounds ago.
        lately = reduce(DataFrame.union, changes[-3:]).distinct()
        asked = skew_join(adj, lately, "node", hot=hot_nodes).select(F.col("other").alias("node")).where(side)
        voting = skew_join(voting, asked.distinct(), "node", "left_semi", hot=hot_nodes)
    votes = (
        skew_join(voting, labels.toDF("other", "label"), "other", hot=hot)
        .groupBy("node", "label")
        .agg(F.sum("w").alias("w"))
    )
    best = (
        votes.join(labels, "node")
        .groupBy("node")
        .agg(
            F.min_by(
                "label",
                F.struct(-F.round("w", 9), (F.col("label") != F.col("cluster")), F.col("label")),
            ).alias("_new")
        )
    )
    moved = materialise(
        labels.join(best, "node", "left").select(
            "node",
            F.coalesce("_new", "cluster").alias("cluster"),
            (F.coalesce("_new", "cluster") != F.col("cluster")).alias("_moved"),
        )
    )
    return moved.select("node", "cluster"), moved.where("_moved").select("node")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, cluster)``: the smallest node reachable from each node.

    Alternates large-star and small-star steps until nothing changes, which takes a
    number of rounds logarithmic in the size of the graph.
    """
    links = materialise(
        edges.where("t1 <> t2").select(
            F.greatest("t1", "t2").alias("u"), F.least("t1", "t2").alias("v")
        ).distinct()
    )
    everything = materialise(
        edges.select(F.explode(F.array("t1", "t2")).alias("node")).distinct()
    )
    while True:
        both = links.union(links.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = skew_join(both, lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = skew_join(large, low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        same = small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty()
        links = small
        if same:
            break
    found = links.groupBy("u").agg(F.min("v").alias("cluster"))
    return everything.join(found.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("cluster", "node").alias("cluster")
    )


def _label_ends(adj: DataFrame, communities: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``(node, other, w, c1, c2)``: both ends of a symmetric adjacency with their communities."""
    other_hot = None if hot is None else hot.withColumnRenamed("node", "other")
    first = skew_join(adj, communities.toDF("node", "c1"), "node", hot=hot)
    return skew_join(first, communities.toDF("other", "c2"), "other", hot=other_hot)


def modularity(adj: DataFrame, communities: DataFrame, hot: DataFrame | str | None = "detect") -> float:
    """Newman modularity of ``(node, cluster)`` on a symmetric adjacency ``(node, other, w)``."""
    if isinstance(hot, str):
        hot = hot_keys(adj, ["node"])
    labelled = _label_ends(adj, communities, hot)
    per = labelled.groupBy("c1").agg(
        F.sum("w").alias("tot"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inside")
    )
    total = per.agg(F.sum("tot")).scalar()
    row = per.withColumn("_2m", total).agg(
        F.sum(F.col("inside") / F.col("_2m") - F.pow(F.col("tot") / F.col("_2m"), F.lit(2.0))).alias("q")
    ).first()
    return float(row["q"] or 0.0)


def _moves(
    adj: DataFrame, comm: DataFrame, side: Column, total: float, hot: DataFrame | None
) -> DataFrame:
    """Communities after the nodes of one side take their best positive gain.

    ``adj`` may hold loops (contracted communities); they count for the degree.
    """
    degree = adj.groupBy("node").agg(F.sum("w").alias("k"))
    state = comm.join(degree, "node")
    tot = state.groupBy("cluster").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("members"))
    links = (
        skew_join(
            adj.where(side & (F.col("node") != F.col("other"))),
            comm.toDF("other", "target"),
            "other",
            hot=None if hot is None else hot.withColumnRenamed("node", "other"),
        )
        .groupBy("node", "target")
        .agg(F.sum("w").alias("k_in"))
    )
    own = state.join(tot, "cluster").select("node", "cluster", "k", F.col("members").alias("mine"))
    options = links.join(own, "node").join(
        tot.select(F.col("cluster").alias("target"), "tot", "members"), "target"
    )
    rest = F.when(F.col("target") == F.col("cluster"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
    gain = F.col("k_in") - F.col("k") * rest / total
    # Two single nodes only join towards the smaller name.
    swap = (F.col("mine") == 1) & (F.col("members") == 1) & (F.col("target") > F.col("cluster"))
    options = options.where(~swap).withColumn("gain", F.round(gain, 9))
    # Without a link to its own community a node leaves only for a better gain than staying alone.
    stay = state.join(tot, "cluster").select(
        "node", F.col("cluster").alias("target"), "k", "tot"
    ).where(side).select(
        "node", "target", F.round(-F.col("k") * (F.col("tot") - F.col("k")) / total, 9).alias("gain")
    )
    options = options.select("node", "target", "gain").union(stay)
    best = options.groupBy("node").agg(
        F.min_by("target", F.struct(-F.col("gain"), F.col("target"))).alias("_new")
    )
    return comm.join(best, "node", "left").select("node", F.coalesce("_new", "cluster").alias("cluster"))


def louvain(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """``(node, cluster)`` by parallel local moves of modularity gain, then contraction.

    A round is kept only when modularity rises, so it never falls.  A level ends when a
    pass over both halves of the nodes brings no rise, the whole when a level does.
    """
    adj = materialise(_adjacency(edges, weighted))
    total = adj.agg(F.sum("w")).first()[0]
    members = materialise(adj.select("node", F.col("node").alias("cluster")).distinct())
    if not total:
        return members
    level_adj = adj
    while True:
        comm = materialise(level_adj.select("node", F.col("node").alias("cluster")).distinct())
        hot = hot_keys(level_adj, ["node"])
        quality, improved, still = modularity(level_adj, comm, hot), False, 0
        for r in count():
            side = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
            moved = materialise(_moves(level_adj, comm, side, total, hot))
            q = modularity(level_adj, moved, hot)
            if q > quality + 1e-9:
                comm, quality, improved, still = moved, q, True, 0
            else:
                still += 1
            if still == 2:
                break
        if not improved:
            break
        members = materialise(
            skew_join(members.withColumnRenamed("cluster", "_c"), comm.toDF("_c", "cluster"), "_c").select(
                "node", "cluster"
            )
        )
        level_adj = materialise(
            _label_ends(level_adj, comm, hot)
            .groupBy("c1", "c2")
            .agg(F.sum("w").alias("w"))
            .toDF("node", "other", "w")
        )
    return members


def citation_communities(
    df: DataFrame, pairs: DataFrame, method: str = "label_propagation"
) -> DataFrame:
    """``(id, cluster, num_documents)``: communities of the undirected citation graph."""
    edges = pairs.select(F.col("citing").alias("t1"), F.col("cited").alias("t2"))
    found = louvain(edges, weighted=False) if method == "louvain" else label_propagation(edges)
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("num_documents"))
    table = skew_join(found, sizes, "cluster").withColumnRenamed("node", "id")
    return df.select("id").join(table, "id")


COUNT = "decimal(38,0)"
CYCLE = "the citation graph has a cycle"


def _exact_sum(value: str) -> Column:
    """Sum of whole numbers, null where it or a part of it has more than 38 digits."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.try_sum(value)).cast(COUNT)


def _chains(links: DataFrame) -> DataFrame | None:
    """``(dir, node, at, w)``: the ends of the chains that nodes lie on; None without any.

    A node with one link in and one out lies on a chain.  ``at`` is the nearest node
    before it (``dir`` f) or after it (b) that does not, ``w`` the sum of the weights up to
    there.  Ways are doubled, so the rounds are logarithmic in the longest chain.
    """
    into = links.groupBy(F.col("dst").alias("node")).agg(
        F.count(F.lit(1)).alias("i"), F.min("src").alias("before"), F.min("w").alias("wi")
    )
    out = links.groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("o"), F.min("dst").alias("after"), F.min("w").alias("wo")
    )
    inner = materialise(into.where("i = 1").join(out.where("o = 1"), "node"))
    n = inner.count()
    if not n:
        return None
    kind = links.schema["w"].dataType
    ways = materialise(
        inner.select(F.lit("f").alias("dir"), "node", F.col("before").alias("at"), F.col("wi").alias("w")).union(
            inner.select(F.lit("b"), "node", "after", "wo")
        )
    )
    for _ in range(n.bit_length() + 2):
        ahead = ways.toDF("dir", "at", "next", "more")
        moved = materialise(
            skew_join(ways, ahead, ["dir", "at"], "left", hot="detect").select(
                "dir",
                "node",
                F.coalesce("next", "at").alias("at"),
                (F.col("w") + F.coalesce("more", F.lit(0))).cast(kind).alias("w"),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        ways = moved.drop("moved")
        if is_empty(moved.where("moved")):
            return ways
    raise ValueError(CYCLE)


def _dag_values(edges: DataFrame, longest: bool, contract: bool = True) -> DataFrame:
    """:func:`_dag_pass` with each chain of nodes as one link.

    Levels are then counted between branching nodes only.  Sums of doubles would depend on
    the way they are added up, so ``contract`` is for whole numbers.
    """
    links = edges if longest else edges.select("src", "dst", F.lit(0).cast(COUNT).alias("w"))
    ways = _chains(links) if contract else None
    if ways is None:
        return _dag_pass(edges, longest)
    kind = links.schema["w"].dataType
    on = ways.where("dir = 'b'").select(F.col("node").alias("dst"), "at", F.col("w").alias("more"))
    heads = links.join(on.select(F.col("dst").alias("src")), "src", "left_anti")
    short = materialise(
        skew_join(heads, on, "dst", "left").select(
            "src",
            F.coalesce("at", "dst").alias("dst"),
            (F.col("w") + F.coalesce("more", F.lit(0))).cast(kind).alias("w"),
        )
    )
    values = _dag_pass(short, longest)
    value = (F.col("value") + F.col("w")).cast(values.schema["value"].dataType) if longest else F.col("value")
    between = skew_join(ways, values.withColumnRenamed("node", "at"), ["dir", "at"], hot="detect").select(
        "dir", "node", value.alias("value"), "approx"
    )
    return materialise(values.union(between))


def _dag_pass(edges: DataFrame, longest: bool) -> DataFrame:
    """``(dir, node, value, approx)`` for both directions of a DAG ``(src, dst[, w])``.

    ``dir`` f runs from the sources, b from the sinks.  The value is the number
    of paths, or with ``longest`` the largest sum of ``w`` on a path.  Numbers of paths
    are exact up to 38 digits and null beyond; ``approx`` holds them as doubles.  A node
    is handled once all its predecessors are, level by level, so each link is read once;
    nodes that never become ready lie on a cycle.
    """
    kind = edges.schema["w"].dataType.simpleString() if longest else COUNT
    w = F.col("w") if longest else F.lit(0).cast(COUNT)
    both = edges.select(
        F.explode(
            F.array(
                F.struct(F.lit("f").alias("dir"), F.col("src").alias("a"), F.col("dst").alias("b")),
                F.struct(F.lit("b").alias("dir"), F.col("dst").alias("a"), F.col("src").alias("b")),
            )
        ).alias("e"),
        w.alias("w"),
    ).select("e.*", "w")
    # Read in every level, so they lie in buckets and only the level itself is shuffled.
    both = bucketed(both, "dir", "a")
    hot = hot_keys(both, ["dir", "a"])
    indegree = bucketed(both.groupBy("dir", F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("need")), "dir", "node")
    nodes = materialise(both.select("dir", F.col("a").alias("node")).union(both.select("dir", "b")).distinct())
    start = 0 if longest else 1
    frontier = materialise(
        nodes.join(indegree, ["dir", "node"], "left_anti")
        .withColumn("value", F.lit(start).cast(kind))
        .withColumn("approx", F.lit(float(start)))
    )
    done, pending, handled = [frontier], None, 0
    while not is_empty(frontier):
        reached = skew_join(both, frontier.withColumnRenamed("node", "a"), ["dir", "a"], hot=hot)
        value = (F.col("value") + F.col("w")).cast(kind) if longest else F.col("value")
        arrived = reached.select(
            "dir", F.col("b").alias("node"), value.alias("value"), "approx", F.lit(1).alias("seen")
        )
        if pending is not None:
            arrived = arrived.union(pending)
        combine = F.max("value") if longest else _exact_sum("value")
        summed = arrived.groupBy("dir", "node").agg(
            combine.alias("value"), F.sum("approx").alias("approx"), F.sum("seen").cast("int").alias("seen")
        )
        state = materialise(
            summed.join(indegree, ["dir", "node"]).select(
                "dir", "node", "value", "approx", "seen", (F.col("seen") == F.col("need")).alias("ready")
            )
        )
        frontier = state.where("ready").select("dir", "node", "value", "approx")
        pending = state.where("NOT ready").select("dir", "node", "value", "approx", "seen")
        done.append(frontier)
    table = done[0]
    for part in done[1:]:
        table = table.union(part)
    table = materialise(table)
    if table.count() != nodes.count():
        raise ValueError(CYCLE)
    return table


def _side(values: DataFrame, direction: str, key: str, name: str) -> DataFrame:
    return values.where(F.col("dir") == direction).select(
        F.col("node").alias(key), F.col("value").alias(name), F.col("approx").alias(f"{name}_approx")
    )


def _dag_links(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct links of a DAG: those of small components with their ``component``, and the others."""
    links = materialise(edges.select("src", "dst").distinct())
    if not is_empty(links.where("(src < dst OR src > dst) IS NOT TRUE")):
        raise ValueError(CYCLE)
    return by_component(links, "src", "dst")


def _weighed(placed: DataFrame, exact: bool, longest: bool) -> DataFrame:
    """The links of small components with their counts (see :func:`graph_blocks.weighed`)."""
    kind = "decimal(38,0)" if exact else "double"
    more = "".join(f", {c} {kind}" for c in ("f_src", "f_dst", "b_src", "b_dst")) if longest else ""
    told = T.StructType.fromDDL("count decimal(38,0), approx double" + more).fields
    kinds = [placed.schema[c] for c in ("component", "src", "dst")]
    out = dealt(placed.select("component", "src", "dst")).mapInArrow(
        partial(weighed, exact=exact, longest=longest), T.StructType([*kinds, *told])
    )
    out = materialise(out)
    if not is_empty(out.where("approx IS NULL")):
        raise ValueError(CYCLE)
    return out


def _counted(links: DataFrame) -> DataFrame:
    """``(src, dst, count, approx)`` by rounds of joins."""
    values = _dag_values(links, longest=False)
    counted = skew_join(skew_join(links, _side(values, "f", "src", "_f"), "src"), _side(values, "b", "dst", "_b"), "dst")
    exact = F.try_multiply("_f", "_b").cast(COUNT)
    return counted.select("src", "dst", exact.alias("count"), (F.col("_f_approx") * F.col("_b_approx")).alias("approx"))


def path_counts(edges: DataFrame, approximate: bool = False) -> DataFrame:
    """``(src, dst, count)``: source-to-sink paths through each link of a DAG.

    Counts are exact up to 38 digits and null beyond.  ``approximate`` adds them as
    doubles in ``approx``.
    """
    small, rest = _dag_links(edges)
    columns = ["src", "dst", "count", *(["approx"] if approximate else [])]
    counted = _weighed(small, exact=True, longest=False).select(*columns)
    return counted if rest is None else counted.union(_counted(rest).select(*columns))


def _longest(weighted: DataFrame, exact: bool) -> DataFrame:
    """``(src, dst, count, f_src, f_dst, b_src, b_dst)`` by rounds of joins."""
    values = _dag_values(weighted.withColumnRenamed("count", "w"), longest=True, contract=exact).drop("approx")
    values = values.withColumn("approx", F.lit(None).cast("double"))
    scored = weighted
    for direction in ("f", "b"):
        for key in ("src", "dst"):
            side = _side(values, direction, key, f"{direction}_{key}").drop(f"{direction}_{key}_approx")
            scored = skew_join(scored, side, key)
    return scored.select("src", "dst", "count", "f_src", "f_dst", "b_src", "b_dst")


def main_path(edges: DataFrame) -> DataFrame:
    """``(src, dst, count)``: links of the key-route and global main paths.

    Links run from cited to citing.  Kept are the links of the best path (largest
    sum of link counts) through each link of largest count, and of the best paths.
    Where counts have more than 38 digits, all are compared, and given, as doubles.
    """
    small, rest = _dag_links(edges)
    scored = _weighed(small, exact=True, longest=True)
    counted = None if rest is None else materialise(_counted(rest))
    exact = all(
        is_empty(t.where(F.col("count").isNull() | (F.col("approx") > 1e36))) for t in (scored, counted) if t is not None
    )
    if not exact:
        scored = _weighed(small, exact=False, longest=True).withColumn("count", F.col("approx"))
    through = (F.col("f_src") + F.col("count") + F.col("b_dst")).alias("through")
    scored = scored.drop("approx").select("*", through)
    tables = [scored]
    if rest is not None:
        weighted = counted.select("src", "dst", F.col("count") if exact else F.col("approx").alias("count"))
        tables.append(materialise(_longest(weighted, exact).select("*", through)))
    tops = [t.agg(F.max("count"), F.max("through")).first() for t in tables]
    if all(row[0] is None for row in tops):
        return scored.select("src", "dst", "count")
    top = [max(x for x in column if x is not None) for column in zip(*tops, strict=True)]
    # Sums of doubles along one path may differ in the last digits.
    slack = 1 if exact else 1 - 1e-12
    best = (F.col("count") >= F.lit(top[0]) * slack) | (F.col("through") >= F.lit(top[1]) * slack)
    # Tight links lead back from the starts and forward from the ends of the chosen ones.
    back = F.col("f_src") + F.col("count") == F.col("f_dst")
    on = F.col("count") + F.col("b_dst") == F.col("b_src")
    columns = ["src", "dst", "count", best.alias("chosen"), back.alias("back"), on.alias("on")]
    marked = scored.select("component", *columns)
    held = marked.join(marked.where("chosen").select("component").distinct(), "component", "left_semi")
    held = held.select(*marked.columns)
    kept = dealt(held).mapInArrow(followed, held.select("src", "dst", "count").schema)
    return kept if rest is None else kept.union(_followed(tables[1].select(*columns)))


def _followed(links: DataFrame) -> DataFrame:
    """The chosen links and those that tight ones lead to from them, by rounds of joins."""
    chosen = links.where("chosen").select("src", "dst", "count")
    tight = materialise(
        links.where("back")
        .select(F.lit("back").alias("way"), F.col("dst").alias("at"), F.col("src").alias("to"), "src", "dst", "count")
        .union(
            links.where("on").select(
                F.lit("on").alias("way"), F.col("src").alias("at"), F.col("dst").alias("to"), "src", "dst", "count"
            )
        )
    )
    reached = materialise(
        chosen.select(F.lit("back").alias("way"), F.col("src").alias("at"))
        .union(chosen.select(F.lit("on").alias("way"), F.col("dst").alias("at")))
        .distinct()
    )
    kept, seen = chosen, reached
    while not is_empty(reached):
        steps = materialise(tight.join(reached, ["way", "at"]))
        kept = kept.union(steps.select("src", "dst", "count"))
        reached = materialise(
            steps.select("way", F.col("to").alias("at")).distinct().join(seen, ["way", "at"], "left_anti")
        )
        seen = seen.union(reached)
    return kept.distinct()


def main_path_nodes(df: DataFrame, path: DataFrame) -> DataFrame:
    """Documents on a main path."""
    nodes = path.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return df.join(nodes, "id", "left_semi")


def ordered_members(clusters: DataFrame, counters: DataFrame) -> DataFrame:
    """``(cluster, rank, term, num_documents, name, size)``: members by documents, named by the first.

    ``clusters`` is ``(cluster, term)`` over a matrix axis, so groups are bounded.
    """
    table = clusters.join(counters, "term")
    first = Window.partitionBy("cluster").orderBy(F.col("num_documents").desc(), F.col("global_citations").desc(), "term")
    every = Window.partitionBy("cluster")
    return table.select(
        "cluster",
        F.row_number().over(first).alias("rank"),
        "term",
        "num_documents",
        F.first("term").over(first).alias("name"),
        F.count(F.lit(1)).over(every).alias("size"),
    )


cluster_members = ordered_members
