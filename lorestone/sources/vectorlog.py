"""A vector store as an append log: segments of chunks, tombstones, compaction.

A chunk is stored under its id with the hash of its content.  Adding embeds only content that the store does not hold yet, under
whatever id, and gives the other chunks the vectors of equal content.  Removing appends tombstones.  Each version is a manifest of segments
with their row counts and hash sums, which reading checks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dequantize, quantize
from ..operators.vectorindex import embed
from ..plans.scale import best_per_key
from ..session import settle
from . import versions as V

KEY, GONE = ["chunk_id"], "removed"


def vectors(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks that the store holds as of a version, with their vectors as they were stored (eight bits a component)."""
    rows = V.last_of_log(V.read_log(spark, path, version), KEY, GONE)
    return rows.withColumn("embedding", dequantize(F.col("q"))).drop("q")


def add(spark: SparkSession, path: str, chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = 64) -> tuple[int, int, int]:
    """Store chunks (chunk_id, text, content_hash and others); (version, chunks with known content, contents embedded).

    Ids are unique within ``chunks``; an id that the store holds is replaced unless its content is the same.
    """
    columns = chunks.columns
    known = None
    if V.versions(spark, path):
        live = settle(V.last_of_log(V.read_log(spark, path), KEY, GONE))
        chunks = chunks.join(live.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")
        known = best_per_key(live.select("content_hash", "q", "chunk_id"), ["content_hash"], [F.asc("chunk_id")]).drop("chunk_id")
    chunks = settle(chunks)
    fresh = best_per_key(chunks.select("content_hash", "text", "chunk_id"), ["content_hash"], [F.asc("chunk_id")]).drop("chunk_id")
    if known is not None:
        fresh = fresh.join(known, "content_hash", "left_anti")
    made = settle(embed(fresh, encode, batch).select("content_hash", quantize(F.col("embedding")).alias("q")))
    every = made if known is None else made.unionByName(known)
    rows = settle(chunks.join(every, "content_hash").select(*columns, "q", F.lit(False).alias(GONE)))
    n, new = rows.count(), made.count()
    held = rows.join(made, "content_hash", "left_semi").count()
    return V.append_segment(spark, path, rows), n - held, new


def remove(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Append tombstones for the chunk ids that the store holds."""
    live = V.last_of_log(V.read_log(spark, path), KEY, GONE)
    return V.append_segment(spark, path, live.join(ids.select("chunk_id").distinct(), KEY, "left_semi").withColumn(GONE, F.lit(True)))


def compact(spark: SparkSession, path: str) -> int:
    return V.compact(spark, path, KEY, GONE)
