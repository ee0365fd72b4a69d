"""Points that no other point of their group dominates, in three measures, without one task for all of them.

Larger ``x`` and ``y`` and smaller ``z`` are better.  Equal points count as one, so a point is dominated exactly if another
is at least as good in each measure, and that other comes before it by (x, y, z) and by (y, x, z).  The points of a group are cut
into ranges by both orders.  Whoever dominates a point lies in its range of the first order, in its range of the second, or in
a better range of both; the first two are swept range by range, and for the third the smallest ``z`` of all better
cells of ranges is enough.

A point that some point dominates is dominated by one that nobody dominates, so each step only sees what the one before left.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .ordered import row_index

#: points of a range; large groups take the root of their size, so that there are no more cells than points
RANGE = 100_000


class Stairs:
    """The best (y, z) so far: rising y, rising z."""

    def __init__(self) -> None:
        self.y: list[float] = []
        self.z: list[float] = []

    def add(self, y: float, z: float) -> bool:
        """Whether nobody has y as large and z as small; if so the point is kept."""
        at = bisect_left(self.y, y)
        if at < len(self.y) and self.z[at] <= z:
            return False
        # those with less y and no less z are of no use any more
        end = at + 1 if at < len(self.y) and self.y[at] == y else at
        begin = min(bisect_left(self.z, z), at)
        self.y[begin:end], self.z[begin:end] = [y], [z]
        return True


def _swept(points: DataFrame, part: str, first: str, second: str) -> DataFrame:
    """Points that no point of their group's range ``part`` dominates."""
    names = points.columns
    of, a, b, z = (names.index(c) for c in ("grp", first, second, "z"))
    at = names.index(part)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stairs = None, Stairs()
        for batch in batches:
            keep = []
            columns = [batch.column(i).to_pylist() for i in (of, at, b, z)]
            for group, range_, second_, z_ in zip(*columns, strict=True):
                if (group, range_) != here:
                    here, stairs = (group, range_), Stairs()
                keep.append(stairs.add(second_, z_))
            yield batch.filter(pa.array(keep, pa.bool_()))

    order = ["grp", part, F.desc(first), F.desc(second), "z"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return settle(points.repartition("grp", part).sortWithinPartitions(*order).mapInArrow(sweep, schema))


def skyline(points: DataFrame, size: int = RANGE) -> DataFrame:
    """(grp, x, y, z): the different undominated points of (grp, x, y, z); measures are doubles without null."""
    points = settle(points.select("grp", "x", "y", "z").distinct())
    sizes = points.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.greatest(F.lit(size), F.ceil(F.sqrt("n"))).cast("long").alias("size"))
    placed = row_index(points, ["grp"], [F.desc("x"), F.desc("y"), "z"], "px")
    placed = row_index(placed, ["grp"], [F.desc("y"), F.desc("x"), "z"], "py")
    sized = placed.join(sizes, placed["grp"].eqNullSafe(sizes["grp"])).drop(sizes["grp"])
    cut = settle(sized.select("grp", "x", "y", "z", F.expr("(px - 1) div size").alias("rx"), F.expr("(py - 1) div size").alias("ry")))
    left = _swept(_swept(cut, "rx", "x", "y"), "ry", "y", "x")
    cells = left.groupBy("grp", "rx", "ry").agg(F.min("z").alias("z"))
    ends = cells.groupBy("grp").agg(F.max("rx").alias("mx"), F.max("ry").alias("my"))
    grid = ends.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), "mx")).alias("rx"), "my").select("grp", "rx", F.explode(F.sequence(F.lit(0).cast("long"), "my")).alias("ry"))
    full = grid.join(cells.withColumnRenamed("grp", "g").withColumnRenamed("rx", "x_").withColumnRenamed("ry", "y_"), F.col("grp").eqNullSafe(F.col("g")) & (F.col("rx") == F.col("x_")) & (F.col("ry") == F.col("y_")), "left")
    # the least z of better ranges of one order, then of both
    above = full.select("grp", "rx", "ry", F.min("z").over(W.partitionBy("grp", "ry").orderBy("rx").rowsBetween(W.unboundedPreceding, -1)).alias("m"))
    best = above.select(F.col("grp").alias("g"), F.col("rx").alias("x_"), F.col("ry").alias("y_"), F.min("m").over(W.partitionBy("grp", "rx").orderBy("ry").rowsBetween(W.unboundedPreceding, -1)).alias("best"))
    hit = left.join(best, F.col("grp").eqNullSafe(F.col("g")) & (F.col("rx") == F.col("x_")) & (F.col("ry") == F.col("y_")), "left")
    return hit.where("best is null or best > z").select("grp", "x", "y", "z")
