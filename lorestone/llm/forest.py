"""Nearest neighbours with a forest of random-projection trees and one priority queue for all of them.

The trees split a bounded sample at the median of random projections.  Every vector is indexed: it
goes to one leaf of each tree.  A query opens the branch with the smallest margin of all trees
next, from one shared queue, until it holds enough leaves; all members of these leaves are scored exactly.

Largest inner products become nearest points by one more component, sqrt(M^2 - |x|^2) with M the
largest norm; it only steers the trees, scores use the original vectors in double precision.

Equal vectors are folded before they are indexed; with the k + 1 smallest ids of each nothing that could be
among k results is lost.  Large leaves are cut into parts by hash, and queries go to every part, so no
task holds a whole leaf.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part.  Equal scores are ordered by id.  Repeated rows count once.  An empty table gives no rows.  Further columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import table
from .registry import query

#: trees, vectors they are fitted on, rows a leaf should hold
TREES, SAMPLE, LEAF_ROWS = 12, 16_384, 256
#: leaves a query opens over all trees among 10,000 vectors; the number grows with the root of the table
OPENED = 96
#: rows of a leaf that go to one task
PART_ROWS = 8_192


def fit(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(directions, thresholds) of complete trees: [tree, node, dimension], [tree, node]; node 1 is the root."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    ways = rng.standard_normal((trees, 1 << depth, dims))
    ways /= np.linalg.norm(ways, axis=2, keepdims=True)
    cuts = np.zeros((trees, 1 << depth))
    for t in range(trees):
        members = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            rows = members.pop(node, np.zeros(0, int))
            p = sample[rows] @ ways[t, node]
            cuts[t, node] = np.median(p) if len(rows) else 0.0
            members[2 * node], members[2 * node + 1] = rows[p < cuts[t, node]], rows[p >= cuts[t, node]]
    return ways, cuts


def leaf_of(x: np.ndarray, ways: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """[row, tree] leaf of every vector."""
    out = np.ones((len(x), len(ways)), np.int64)
    for t in range(len(ways)):
        for _ in range(depth):
            node = out[:, t]
            p = np.einsum("ij,ij->i", x, ways[t, node])
            out[:, t] = 2 * node + (p >= cuts[t, node])
    return out


def leaves_for(q: np.ndarray, ways: np.ndarray, cuts: np.ndarray, depth: int, opened: int) -> list[tuple[int, int]]:
    """The leaves (tree, leaf) in the order in which the shared queue reaches them."""
    queue = [(0.0, t, 1) for t in range(len(ways))]
    found = []
    while queue and len(found) < opened:
        margin, t, node = heapq.heappop(queue)
        while node < 1 << depth:
            p = float(q @ ways[t, node] - cuts[t, node])
            near = 2 * node + (p >= 0)
            heapq.heappush(queue, (max(margin, abs(p)), t, near ^ 1))
            node = near
        found.append((t, node))
    return found


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims)


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query."""
    spark = vectors.sparkSession
    v = F.col("v")
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), is_query.alias("asked"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    usable = plain.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True))).where(square > 0)
    facts = usable.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(square).alias("m")).orderBy(F.desc("n"), "dims").first()
    kind = plain.schema["v"].dataType.simpleString()
    out = "query_id long, rank int, vec_id long, score double"
    if facts is None:
        return spark.createDataFrame([], out)
    dims, total, most = facts["dims"], facts["n"], facts["m"]
    usable = usable.where(F.size("v") == dims)
    folded = _smallest(usable.select("id", "v"), k + 1)
    folded = settle(folded.withColumn("vid", F.xxhash64("v")))
    depth = max(0, min(math.ceil(math.log2(max(1, total / LEAF_ROWS))), int(math.log2(SAMPLE)) - 3))
    opened = math.ceil(OPENED * max(1.0, total / 10_000) ** 0.5)
    sample = folded.orderBy("vid").limit(SAMPLE).select("v").toArrow().column("v")

    def lifted(x: np.ndarray, norm: float | None) -> np.ndarray:
        if norm is None:  # a query has nothing in the new component
            return np.hstack([x * (math.sqrt(most) / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(0.0, norm - (x * x).sum(1, keepdims=True)))])

    model = spark.sparkContext.broadcast(fit(lifted(_matrix(sample, dims), most), depth))  # bounded by TREES * SAMPLE / 8 nodes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways, cuts = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = leaf_of(lifted(_matrix(batch.column(0), dims), most), ways, cuts, depth)
            n, trees = leaf.shape
            where = (np.arange(trees) * (2 << depth) + leaf).ravel()
            rows = np.repeat(np.arange(n), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), *[c.take(pa.array(rows)) for c in batch.columns]], names=["leaf", "v", "vid"]
            )

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways, cuts = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, where = [], []
            for i, q in enumerate(lifted(_matrix(batch.column(1), dims), None)):
                found = leaves_for(q, ways, cuts, depth, opened)
                rows += [i] * len(found)
                where += [t * (2 << depth) + leaf for t, leaf in found]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), *[c.take(pa.array(rows)) for c in batch.columns]], names=["leaf", "qid", "q"])

    members = folded.select("v", "vid").mapInArrow(index, f"leaf long, v {kind}, vid long")
    # one row per leaf
    parts = settle(members.groupBy("leaf").agg((1 + F.floor(F.count("*") / PART_ROWS)).cast("int").alias("parts")))
    again = parts.withColumnsRenamed({"leaf": "of", "parts": "number"})
    # queries with equal vectors are searched once
    asked = usable.where("asked").select("id", "v").withColumn("qid", F.xxhash64("v"))
    once = asked.groupBy("qid").agg(F.first("v").alias("q"))
    going = once.mapInArrow(visits, f"leaf long, qid long, q {kind}").join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = members.join(again, F.col("leaf") == F.col("of")).select("leaf", "v", "vid", F.pmod("vid", "number").cast("int").alias("part"))

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, columns, values = [], [], []
        if len(left) and len(right):
            x = np.stack(left["v"].to_numpy()).astype(np.float64)
            asked_ = np.stack(right["q"].to_numpy()).astype(np.float64)
            cut = len(x) - k - 1
            for at in range(0, len(asked_), 256):
                found = np.einsum("ij,kj->ik", asked_[at: at + 256], x, optimize=False)
                # equal scores at the cut all stay
                least = np.partition(found, cut, axis=1)[:, cut] if cut > 0 else found.min(axis=1)
                row, column = np.nonzero(found >= least[:, None])
                rows.append(row + at)
                columns.append(column)
                values.append(found[row, column])
        every = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        return pd.DataFrame({"qid": right["qid"].to_numpy()[every(rows, int)], "vid": left["vid"].to_numpy()[every(columns, int)], "score": every(values, float)})

    scored = dealt.groupBy("leaf", "part").cogroup(going.groupBy("leaf", "part")).applyInPandas(score, "qid long, vid long, score double")
    unique = scored.groupBy("qid", "vid").agg(F.max("score").alias("score"))
    # every vector has an id, so k + 1 different vectors, with all that equal the last, hold the k + 1 best ids
    near = unique.withColumn("near", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("near") <= k + 1)
    flat = near.join(folded.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    best = settle(flat.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1))
    own = asked.select(F.col("id").alias("query_id"), "qid").distinct()
    answers = own.join(best, "qid").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy("place")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids) with the k smallest ids of every vector; tasks cut to k before the shuffle."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.distinct().withColumn("place", place).where(F.col("place") <= k).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query("op6_forest")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
