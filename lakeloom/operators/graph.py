"""Graph kernels over edge tables: degrees, cores, components, paths, depths and strong components.

Iterative ones loop over frames and cut lineage with a reliable checkpoint every round; the driver
sees counts only.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts
from .state import checkpointed

#: Edges that one task holds to solve whole components; larger components are solved in rounds over all tasks.
MOST_EDGES = 1 << 20


def symmetric(edges: DataFrame) -> DataFrame:
    """``a, b, ...`` with every edge in both directions, once."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select("a", "b", *rest).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest)).distinct()


def degrees(edges: DataFrame, score: str | None = None) -> DataFrame:
    """``node, degree`` and, with ``score``, the mean score of a node's edges."""
    found = [F.count("*").alias("degree"), *([F.avg(score).alias("density")] if score else [])]
    return symmetric(edges).groupBy(F.col("a").alias("node")).agg(*found)


def components(edges: DataFrame, cut=checkpointed) -> DataFrame:
    """``node, component``: the smallest node that each node of an edge can reach.

    Alternates two steps until nothing changes: every node ties its larger neighbours, then its smaller ones, to
    the smallest node it knows. Each takes a grouped minimum, which is aggregated before it is shuffled, and a
    join on the node, whose hot keys Spark can split; ``cut`` ends the lineage of each round.
    """
    both = edges.select("a", "b")
    nodes = symmetric(both).select(F.col("a").alias("node")).distinct()
    links = cut(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda rows: tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(links)
    while seen[0]:
        around = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        now = state(links)
        if now == seen:
            break
        seen = now
    return nodes.join(links, nodes["node"] == links["a"], "left").select("node", F.coalesce("b", "node").alias("component"))


def clusters(edges: DataFrame, most: int, limit: int | None = None, score: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``node, cluster, component, place`` and ``cluster, component, size, links, mean_score, truncated`` of linked nodes.

    A cluster is a component, or a slice of ``most`` of its nodes in their order where it has more. Clusters are numbered from 1 by
    component, then slice; those beyond ``limit`` are left out. ``truncated`` says that a component was cut, or that some were left out.
    ``links`` are the edges inside a cluster, ``mean_score`` the mean of their ``score``. Numbers come from range partitions and their sizes, so
    that a component of any size is the work of many tasks.
    """
    from .profile import global_row_number

    held = checkpointed(edges.where("a <> b"))
    numbered = checkpointed(global_row_number(components(held), ["component", "node"]))
    first = numbered.groupBy("component").agg(F.min("_row").alias("_first"), F.count("*").alias("_nodes"))
    placed = numbered.join(first, "component").withColumn("place", F.col("_row") - F.col("_first") + 1)
    placed = placed.withColumn("_slice", F.floor((F.col("place") - 1) / most))
    heads = global_row_number(placed.select("component", "_slice").distinct(), ["component", "_slice"]).withColumnRenamed("_row", "cluster")
    nodes = checkpointed(placed.join(heads, ["component", "_slice"]).select("node", "cluster", "component", "place", (F.col("_nodes") > most).alias("_cut")))
    over = limit is not None and not nodes.where(F.col("cluster") > limit).isEmpty()
    if limit is not None:
        nodes = nodes.where(F.col("cluster") <= limit)
    ends = nodes.select("node", "cluster")
    pairs = held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col(score) if score else F.lit(None).cast("double")).alias("_score")).groupBy("a", "b").agg(F.max("_score").alias("_score"))
    inner = pairs.join(ends.toDF("a", "cluster"), "a").join(ends.toDF("b", "cluster_b"), "b").where("cluster = cluster_b")
    inner = inner.groupBy("cluster").agg(F.count("*").alias("links"), F.avg("_score").alias("mean_score"))
    sizes = nodes.groupBy("cluster", "component").agg(F.count("*").alias("size"), F.max("_cut").alias("_cut"))
    summary = sizes.join(inner, "cluster", "left").select("cluster", "component", "size", F.coalesce("links", F.lit(0)).alias("links"), "mean_score", (F.col("_cut") | F.lit(over)).alias("truncated"))
    return nodes.drop("_cut"), summary


def in_one_task(edges: DataFrame, solve, schema: str) -> DataFrame:
    """What ``solve`` returns for all edges together; the caller has checked their number."""
    return edges.select("a", "b", F.lit(0).alias("group")).groupBy("group").applyInArrow(lambda table: solve(table.select(["a", "b"])), schema)


def by_component(edges: DataFrame, schema: str, solve, rounds) -> DataFrame:
    """What ``solve`` returns for the edges ``a, b`` of whole components, as rows of ``schema``.

    Components of up to ``MOST_EDGES`` edges are dealt into groups, each the work of one task with
    a bounded table; ``rounds`` gets the edges of larger ones and works over all tasks. A graph that is
    no larger than that is one group, without a search for its components.
    """
    if edges.count() <= MOST_EDGES:
        return in_one_task(edges, solve, schema)
    of = components(edges)
    named = checkpointed(edges.join(of, edges["a"] == of["node"]).select("a", "b", "component"))
    sizes = checkpointed(named.groupBy("component").agg(F.count("*").alias("_n")))
    small = sizes.where(F.col("_n") <= MOST_EDGES)
    groups = -(-4 * (small.agg(F.sum("_n")).first()[0] or 0) // MOST_EDGES)
    found = None
    if groups:
        dealt = named.join(small, "component").select("a", "b", F.pmod(F.xxhash64("component"), F.lit(groups)).alias("group"))
        found = dealt.groupBy("group").applyInArrow(lambda table: solve(table.select(["a", "b"])), schema)
    large = sizes.where(F.col("_n") > MOST_EDGES)
    if large.isEmpty():
        return found
    more = rounds(checkpointed(named.join(large, "component").select("a", "b")))
    return more if found is None else found.unionByName(more)


def core_numbers(edges: DataFrame) -> DataFrame:
    """``node, core int``: the largest k for which the node is in a subgraph of degrees of at least k.

    Edges from a node to itself and edges with a null end do not count, repeated ones count once. Components
    are solved within tasks (``by_component``); larger ones are peeled over all tasks until what is left fits one.
    """
    both = checkpointed(symmetric(edges.select("a", "b").where("a <> b")))
    schema = f"node {dict(both.dtypes)['a']}, core int"
    return by_component(both, schema, parts.cores, lambda large: peeled(large, schema))


def peeled(both: DataFrame, schema: str) -> DataFrame:
    """``node, core`` of edges in both directions, by rounds that remove all nodes of the lowest degrees."""
    left, done, k, size = both, [], 0, both.count()
    while size > MOST_EDGES:
        degree = checkpointed(left.groupBy("a").agg(F.count("*").alias("degree")))
        k = max(k, degree.agg(F.min("degree")).first()[0])
        gone = degree.where(F.col("degree") <= k).select(F.col("a").alias("node"))
        kept = checkpointed(left.join(gone, left["a"] == gone["node"], "left_anti").join(gone, F.col("b") == gone["node"], "left_anti"))
        # with a node's last neighbours goes the node, at this k
        at = kept.select("a").distinct()
        done.append(degree.join(at, "a", "left_anti").select(F.col("a").alias("node"), F.lit(k).alias("core")))
        if len(done) == 16:
            done = [checkpointed(functools.reduce(DataFrame.unionAll, done))]
        left, size = kept, kept.count()
    if size:
        done.append(in_one_task(left, functools.partial(parts.cores, least=k), schema))
    return functools.reduce(DataFrame.unionAll, done)


def best_paths(edges: DataFrame, hops: int, least: float) -> DataFrame:
    """``a, b, score, hops``: largest product of scores over simple paths of 2 to ``hops`` edges, paths under ``least`` pruned; ties to fewer hops."""
    both = symmetric(edges.select("a", "b", "score"))
    step = both.select(F.col("a").alias("at"), F.col("b").alias("to"), F.col("score").alias("s"))
    paths = both.select("a", "b", "score", F.array("a", "b").alias("nodes")).where(F.col("score") >= least)
    found = None
    for n in range(2, hops + 1):
        longer = paths.join(step, paths.b == step["at"]).where(~F.array_contains("nodes", F.col("to")))
        longer = longer.select("a", F.col("to").alias("b"), (F.col("score") * F.col("s")).alias("score"), F.concat("nodes", F.array("to")).alias("nodes"))
        paths = checkpointed(longer.where(F.col("score") >= least))
        part = paths.select("a", "b", "score", F.lit(n).alias("hops"))
        found = part if found is None else found.unionAll(part)
    best = F.max_by(F.struct("score", "hops"), F.struct("score", -F.col("hops"))).alias("x")
    return found.where("a < b").groupBy("a", "b").agg(best).select("a", "b", "x.score", "x.hops")


def depths(parents: DataFrame) -> DataFrame:
    """``node, depth`` from ``node, parent``: roots have 0; nodes on a cycle or under one are roots of their own, with 0.

    Fronts and nodes grow with the table, so joins with them are merged: a broadcast would pass each of them through the driver.
    """
    held = checkpointed(parents.select("node", "parent"))
    known = held.where(F.col("parent").isNull()).select("node", F.lit(0).alias("depth"))
    orphans = held.join(held.select(F.col("node").alias("p")).hint("merge"), F.col("parent") == F.col("p"), "left_anti").where(F.col("parent").isNotNull()).select("node", F.lit(0).alias("depth"))
    known = checkpointed(known.unionAll(orphans).distinct())
    front, depth = known, 0
    while not front.isEmpty():
        depth += 1
        front = checkpointed(held.join(front.select(F.col("node").alias("p")).hint("merge"), F.col("parent") == F.col("p")).select("node", F.lit(depth).alias("depth")).distinct())
        known = known.unionAll(front)
    return checkpointed(known.unionAll(held.join(known.hint("merge"), "node", "left_anti").select("node", F.lit(0).alias("depth")).distinct()))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component``: nodes that reach each other share the smallest of them.

    Edges with a null end do not count. Weak components are solved within tasks (``by_component``); larger ones by
    ``coloured`` over all tasks until what is left fits one.
    """
    held = checkpointed(edges.select("a", "b").where("a is not null and b is not null").distinct())
    kind = dict(held.dtypes)["a"]
    schema = f"node {kind}, component {kind}"
    return by_component(held, schema, parts.strong, lambda large: coloured(large, schema))


def coloured(edges: DataFrame, schema: str) -> DataFrame:
    """``node, component`` of directed edges, by the smallest node that reaches each node and the smallest that it reaches.

    Both spread in the same job, and jump to what the node they name has found, so that chains take about the logarithm of
    their length. Where the two are equal, that node's component is found; nodes of one component have
    equal pairs, so edges between different pairs go, and the rest is coloured again.
    """
    left, nodes = edges, checkpointed(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    done, size = [], left.count()
    while size > MOST_EDGES:
        mark = nodes.select("node", F.col("node").alias("f"), F.col("node").alias("t"))
        while True:
            ahead = left.join(mark, left["a"] == mark["node"]).select(F.col("b").alias("node"), "f", F.lit(None).alias("t"))
            behind = left.join(mark, left["b"] == mark["node"]).select(F.col("a").alias("node"), F.lit(None).alias("f"), "t")
            near = ahead.unionAll(behind).groupBy("node").agg(F.min("f").alias("nf"), F.min("t").alias("nt"))
            spread = checkpointed(mark.join(near, "node", "left").select("node", F.least("f", "nf").alias("f"), F.least("t", "nt").alias("t"), "f", "t").toDF("node", "f", "t", "of", "ot"))
            jump = spread.join(spread.select(F.col("node").alias("f"), F.col("f").alias("ff")), "f").join(spread.select(F.col("node").alias("t"), F.col("t").alias("tt")), "t")
            after = checkpointed(jump.select("node", F.least("f", "ff").alias("f"), F.least("t", "tt").alias("t"), "of", "ot"))
            mark = after.select("node", "f", "t")
            if after.where("f <> of or t <> ot").isEmpty():
                break
        done.append(mark.where("f = t").select("node", F.col("f").alias("component")))
        if len(done) == 16:
            done = [checkpointed(functools.reduce(DataFrame.unionAll, done))]
        rest = mark.where("f <> t")
        one, other = rest.toDF("a", "f", "t"), rest.toDF("b", "f2", "t2")
        left = checkpointed(left.join(one, "a").join(other, "b").where("f = f2 and t = t2").select("a", "b"))
        nodes, size = checkpointed(rest.select("node")), left.count()
    if size:
        done.append(checkpointed(in_one_task(left, parts.strong, schema)))
        nodes = nodes.join(done[-1], "node", "left_anti")
    done.append(nodes.select("node", F.col("node").alias("component")))
    return functools.reduce(DataFrame.unionAll, done)
