"""Ranges over an ordered domain, as few aligned pieces of doubling length.

Places 0, 1, 2, ... are the leaves of a binary tree; node (level, node) covers ``2 ** level`` of them.  Each range
is the union of at most two nodes per level, so what is stored per node answers for any range, however many
places it has, by an equi-join on a few nodes instead of a comparison with each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import top_per_key


def nodes_of(place: Column, levels: int) -> Column:
    """The nodes above a place, one per level."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels)),
        lambda l: F.struct(l.alias("level"), F.call_function("div", place.cast("long"), F.pow(F.lit(2.0), l).cast("long")).alias("node")),
    )


def pieces(low: Column, end: Column, levels: int) -> Column:
    """The nodes that make up the places from ``low`` up to but without ``end``; empty where there are none."""
    node = "array<struct<level:int,node:bigint>>"
    start = F.struct(low.cast("long").alias("a"), F.greatest(low, end).cast("long").alias("b"), F.array().cast(node).alias("out"))

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        left = (a < b) & (a % 2 == 1)
        a_up = F.when(left, a + 1).otherwise(a)
        right = (a_up < b) & (b % 2 == 1)
        add = lambda hit, at: F.when(hit, F.array(F.struct(level.cast("int").alias("level"), at.cast("long").alias("node")))).otherwise(F.array().cast(node))
        return F.struct(
            F.call_function("div", a_up, F.lit(2)).cast("long").alias("a"),
            F.call_function("div", F.when(right, b - 1).otherwise(b), F.lit(2)).cast("long").alias("b"),
            F.concat(acc["out"], add(left, a), add(right, b - 1)).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["out"])


def stored_tops(rows: DataFrame, place: str, levels: int, orders: dict[str, list[Column]], k: int) -> DataFrame:
    """(kind, level, node, rank, columns of ``rows``): the first k rows of each node in each of the orders.

    A node's rows are among those of its two halves, so nodes are cut to k rows level by level and no row
    is repeated for all nodes above it.
    """
    out: DataFrame | None = None
    for kind, order in orders.items():
        here = rows.withColumn("level", F.lit(0)).withColumn("node", F.col(place).cast("long"))
        for level in range(levels + 1):
            if level:
                here = here.drop("rank").withColumn("level", F.lit(level)).withColumn("node", F.expr("node div 2"))
            here = top_per_key(here, ["level", "node"], order, k)
            part = here.withColumn("kind", F.lit(kind))
            out = part if out is None else out.unionByName(part)
    return out
