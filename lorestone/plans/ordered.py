"""Order-dependent work without a single-task window.

A window without partition keys, or with a hot key, sorts its rows in one task.  The functions here
cut the ordered rows into ranges instead, work inside each range in parallel, and carry totals and
neighbours across the range borders through a table with one row per range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .scale import growing

RANGE = "_range"


def _plain(order: list[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def in_ranges(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Rows range-partitioned by keys and order, with the range number in ``_range``.

    Range borders come from sampling, so the frame is settled before it is read twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *_plain(order))
    return settle(ranged.withColumn(RANGE, F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running totals per key in the given total order.

    ``sums`` maps a new column to the expression that is added up; ``F.lit(1)`` gives row numbers.
    """
    ranged = in_ranges(df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()]), keys, order)
    inside = W.partitionBy(RANGE, *keys).orderBy(*_plain(order)).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    local = ranged.select("*", *[F.sum(f"_v_{n}").over(inside).alias(n) for n in sums])
    # one row per range and key: at most the number of ranges per hot key
    totals = ranged.groupBy(RANGE, *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        RANGE, *keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    return _join_on(local, carried, [RANGE, *keys]).select(
        *df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums]
    )


def row_index(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "pos") -> DataFrame:
    """1-based position of every row within its key."""
    return running_sums(df, keys, order, {name: F.lit(1)})


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
) -> DataFrame:
    """Values of the previous (``before``) and next (``after``) row of the same key."""
    before, after = before or {}, after or {}
    carried = {**{f"_p_{n}": e for n, e in before.items()}, **{f"_n_{n}": e for n, e in after.items()}}
    ranged = in_ranges(df.select("*", *[e.alias(n) for n, e in carried.items()]), keys, order)
    w = W.partitionBy(RANGE, *keys).orderBy(*_plain(order))
    local = ranged.select(
        "*",
        F.row_number().over(w).alias("_first"),
        F.lead(F.lit(0)).over(w).alias("_has_next"),
        *[F.lag(f"_p_{n}").over(w).alias(n) for n in before],
        *[F.lead(f"_n_{n}").over(w).alias(n) for n in after],
    )
    border = local.where((F.col("_first") == 1) | F.col("_has_next").isNull())
    edge = border.groupBy(RANGE, *keys).agg(
        *[F.max(F.when(F.col("_has_next").isNull(), F.struct(f"_p_{n}"))).alias(f"_p_{n}") for n in before],
        *[F.max(F.when(F.col("_first") == 1, F.struct(f"_n_{n}"))).alias(f"_n_{n}") for n in after],
        F.lit(1).alias("_edge"),
    )
    across = W.partitionBy(*keys).orderBy(RANGE)
    edge = edge.select(
        RANGE, *keys,
        *[F.lag(f"_p_{n}").over(across)[f"_p_{n}"].alias(f"_e_{n}") for n in before],
        *[F.lead(f"_n_{n}").over(across)[f"_n_{n}"].alias(f"_f_{n}") for n in after],
    )
    # with many keys there is an edge for nearly every row
    joined = _join_on(local, growing(edge) if keys else edge, [RANGE, *keys])
    return joined.select(
        *df.columns,
        *[F.when(F.col("_first") == 1, F.col(f"_e_{n}")).otherwise(F.col(n)).alias(n) for n in before],
        *[F.when(F.col("_has_next").isNull(), F.col(f"_f_{n}")).otherwise(F.col(n)).alias(n) for n in after],
    )


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join with NULL keys matching each other."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    joined = left.join(right, cond)
    for k in keys:
        joined = joined.drop(right[k])
    return joined
