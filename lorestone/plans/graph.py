"""Iterative graph work: breadth-first search, parent chains, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .scale import growing


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected view of an edge table."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    flipped = edges.select(F.col(dst).alias(src), F.col(src).alias(dst), *rest)
    return edges.select(src, dst, *rest).unionByName(flipped)


def reachable(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, node, hops) of the nodes within ``depth`` hops of each seed, seeds at 0 hops.

    ``seeds`` has (root, node), ``edges`` has (src, dst).  Every step joins the newest frontier only.
    """
    seen = seeds.select("root", "node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        step = (
            frontier.select("root", F.col("node").alias("src"))
            .join(edges.select("src", "dst").distinct(), "src")
            .select("root", F.col("dst").alias("node"))
            .distinct()
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        frontier = settle(step)
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def reaches_origin(nodes: DataFrame) -> DataFrame:
    """(id, complete): whether the parent chain of a node ends at an origin.

    ``nodes`` has unique (id, origin, parent).  Pointers are doubled in every round, so a chain of
    length n takes log2(n) rounds.  A missing parent and a cycle both give false.
    """
    end = F.col("origin") | F.col("parent").isNull()
    state = settle(
        nodes.select(
            "id", F.coalesce("origin", F.lit(False)).alias("origin"), "parent"
        ).select(
            "id",
            F.when(F.col("origin"), F.lit(True)).when(F.col("parent").isNull(), F.lit(False)).alias("done"),
            F.when(end, F.lit(None)).otherwise(F.col("parent")).alias("jump"),
        )
    )
    total = state.count()
    reach = 1
    while reach <= total:
        step = state.select(
            F.col("id").alias("jump"), F.col("done").alias("j_done"), F.col("jump").alias("j_jump"),
            F.lit(True).alias("known"),
        )
        state = settle(
            state.join(step, "jump", "left").select(
                "id",
                F.when(F.col("done").isNotNull(), F.col("done"))
                .when(F.col("known").isNull(), F.lit(False))
                .otherwise(F.col("j_done"))
                .alias("done"),
                F.when(F.col("done").isNull() & F.col("j_done").isNull(), F.col("j_jump")).alias("jump"),
            )
        )
        reach *= 2
        if state.where("done is null").isEmpty():
            break
    # what is still open after more steps than nodes runs in a cycle
    return state.select("id", F.coalesce("done", F.lit(False)).alias("complete"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each connected component.

    Every round takes the smallest label among the neighbours and then follows the label of the
    label, so labels travel twice as far in each round.
    """
    links = settle(both_ways(edges.select("src", "dst").where("src <> dst")).distinct())
    labels = settle(nodes.select(F.col("node"), F.col("node").alias("component")).distinct())
    while True:
        near = (
            links.join(growing(labels.select(F.col("node").alias("dst"), "component")), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(growing(near), "node", "left").select(
            "node", F.least("component", F.coalesce("near", "component")).alias("component"),
            F.col("component").alias("old"),
        )
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        nxt = settle(
            hooked.join(growing(jump), "component", "left").select(
                "node", F.least("component", F.coalesce("up", "component")).alias("component"), "old"
            )
        )
        changed = not nxt.where("component <> old").isEmpty()
        labels = nxt.select("node", "component")
        if not changed:
            return labels


def loop_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, components, first Betti number and normalised persistence."""
    v = nodes.select("node").distinct()
    comp = components(v, edges)
    counts = (
        comp.agg(F.count("*").alias("vertices"), F.count_distinct("component").alias("components"))
        .withColumn("edges", edges.agg(F.count("*")).scalar())
    )
    betti = F.greatest(F.col("edges") + F.col("components") - F.col("vertices"), F.lit(0))
    return counts.select(
        "vertices", "edges", "components", betti.alias("betti_1"),
        F.when(F.col("vertices") <= 1, F.lit(0.0))
        .otherwise(F.log(1.0 + betti) / F.log(1.0 + F.col("vertices")))
        .alias("persistence"),
    )
