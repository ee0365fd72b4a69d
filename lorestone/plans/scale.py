"""Small plan helpers: rankings and top rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows per key.

    Written as ``row_number() <= k`` so that Spark cuts every partition to k rows per key before
    the shuffle; a hot key then ships k rows per partition only.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Rank all rows per key; for keys whose rows are a result list."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def by_score(tie: str, score: str = "score") -> list[Column]:
    """Highest score first; scores equal to nine digits are ordered by ``tie``.

    Sums of the same terms differ in the last bits with the order of adding, so raw values would
    order equal scores by chance.
    """
    return [F.desc(F.round(score, 9)), F.asc(tie)]


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "_one").drop("_one")


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is shuffled.

    Parquet holds ids and codes in a fraction of what they take in memory, so Spark takes a stored table of
    millions of rows for a small one and copies it to the driver and to every executor.
    """
    return df.hint("merge")
