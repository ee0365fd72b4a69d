"""Exact set similarity without comparing all pairs.

Two sets with Jaccard similarity of at least t share a value among the first
``n - ceil(t * n) + 1`` of their values in any common order.  With rare values first, only sets that
share a rare value meet.  Equal sets are folded into one before anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import jaccard
from ..session import cleaned, release, settle
from .scale import best_per_key, growing

#: hash ranges whose values are counted together
RANGE_BITS = 18
#: hash ranges whose parity marks a set
MARK_BITS = 512


def distinct_sets(df: DataFrame, id_col: str, set_col: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep) and (sets: rep, items) with one representative per equal set.

    The representative is the smallest id.  Grouping by a digest keeps long sets out of the shuffle
    and a large group of copies is pre-aggregated on the map side.
    """
    keyed = settle(
        df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(set_col)).alias("items")).withColumn(
            "digest", F.sha2(F.array_join("items", "\u0001"), 256)
        )
    )
    reps = keyed.groupBy("digest").agg(F.min("id").alias("rep"))
    members = settle(keyed.select("id", "digest").join(growing(reps), "digest").select("id", "rep"))
    sets = settle(
        keyed.where(F.size("items") > 0)
        .join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        .select(F.col("id").alias("rep"), "items")
    )
    release(keyed)
    return members, sets


def _counts(hashes: DataFrame) -> np.ndarray:
    """How often values of each hash range occur; 2**RANGE_BITS numbers, whatever the input."""
    place = F.shiftrightunsigned("h", 64 - RANGE_BITS).alias("place")
    with cleaned(hashes.sparkSession):
        found = hashes.select(F.explode("hashes").alias("h")).groupBy(place).agg(F.count("*").alias("df")).toArrow()
    counts = np.zeros(1 << RANGE_BITS, np.int64)
    counts[found.column("place").to_numpy()] = found.column("df").to_numpy()
    return counts


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, value) rows of the rare-first prefix of every set, split by size; a value is a hash.

    Similar sets differ in size by at most the factor 1 / t, so each value is paired with the size
    class of the set and the next one; sets of very different size never meet.  Any common order of the values is right, so
    they are ordered by the count of their hash range, hash and value.  Each set is cut where it lies
    and only the prefixes are shuffled.  Equal hashes add candidates, which are compared by their items.
    """
    n = F.size("items")
    # n - ceil(t n) + 1, guarded against t n being stored a hair above a whole number
    keep = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    band = F.floor(F.log(n.cast("double")) / math.log(1.0 / threshold) + 1e-9)
    hashes = sets.select("rep", band.alias("band"), keep.alias("keep"), F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    counts = sets.sparkSession.sparkContext.broadcast(_counts(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        for batch in batches:
            keys = batch.column(3)
            row = pc.list_parent_indices(keys).to_numpy(zero_copy_only=False)
            found = pc.list_flatten(keys).to_numpy(zero_copy_only=False)
            df = known[found.view(np.uint64) >> np.uint64(64 - RANGE_BITS)]
            # the items are sorted, and the sort is stable
            order = np.lexsort((found, df, row))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < batch.column(2).to_numpy()[row]
            at = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found[order][kept])], names=["rep", "band", "h"])

    kind = sets.schema["rep"].dataType.simpleString()
    first = hashes.mapInArrow(run, f"rep {kind}, band long, h long")
    return first.select("rep", "h", F.explode(F.array("band", F.col("band") + 1)).alias("band")).select(
        "rep", F.xxhash64("band", "h").alias("value")
    )


def _marks(sets: DataFrame) -> DataFrame:
    """(rep, n, marks): size, and the parity of the number of items in each of MARK_BITS hash ranges, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            row = pc.list_parent_indices(keys).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.list_flatten(keys).to_numpy(zero_copy_only=False).view(np.uint64)
            place = row * MARK_BITS + (found % np.uint64(MARK_BITS)).astype(np.int64)
            odd = np.bincount(place, minlength=batch.num_rows * MARK_BITS).astype(np.uint8) & 1
            marks = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(odd).view(np.int64)), MARK_BITS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], names=["rep", "n", "marks"])

    kind = sets.schema["rep"].dataType.simpleString()
    hashes = sets.select("rep", F.size("items").alias("n"), F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    return settle(hashes.mapInArrow(run, f"rep {kind}, n int, marks array<long>"))


def _possible(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs that their marks do not rule out: a mark that differs proves an item that only one of them has."""
    side = lambda x: growing(marks.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}")))
    apart = F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    total = F.col("n_a") + F.col("n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return settle(both.where(total - apart >= threshold * (total + apart) - 1e-6).select("a", "b"))


def _among(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets whose bucket holds an id of a pair, so that others are not shuffled; the joins are exact anyway."""
    bucket = F.pmod(F.xxhash64("rep"), F.lit(1 << RANGE_BITS)).cast("int")
    with cleaned(sets.sparkSession):
        found = pairs.select(F.explode(F.array("a", "b")).alias("rep")).select(bucket.alias("at")).distinct().toArrow()
    wanted = np.zeros(1 << RANGE_BITS, np.uint8)
    wanted[found.column("at").to_numpy()] = 1
    return sets.where(F.substring(F.lit(wanted.tobytes()), bucket + 1, F.lit(1)) == F.lit(b"\x01"))


def _verified(pairs: DataFrame, sets: DataFrame, marks: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """(a, b, similarity) of the candidate pairs that reach the threshold."""
    pairs = _possible(pairs, marks, threshold)
    sets = _among(sets, pairs)
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b"))
    sim = jaccard(F.col("items_a"), F.col("items_b"))
    full = pairs.join(growing(left), "a").join(growing(right), "b").select("a", "b", sim.alias("similarity"))
    return full.where((F.col("similarity") > threshold) if strict else (F.col("similarity") >= threshold))


def leaders(df: DataFrame, id_col: str, set_col: str, threshold: float) -> DataFrame:
    """Greedy first-come clustering: (id, leader, similarity) for every row.

    Going through the ids in order, a row joins the most similar earlier leader when the similarity
    is above the threshold, and becomes a leader otherwise.  While some prefix blocks are large, the
    leaders are found in rounds: a set that is the smallest open one in all its blocks has no open
    earlier neighbour, so it is a leader; the open sets that are similar to it are members.  Such a
    round compares a block with one leader, never with itself, and a family of near copies is gone
    after one of them.  Once the blocks are small, their pairs are listed and the rest is settled.
    """
    members, sets = distinct_sets(df, id_col, set_col)
    blocks = settle(prefixes(sets, threshold))
    marks = _marks(sets)
    open_blocks, found, slow = blocks, None, False
    while True:
        if slow or _pairs_affordable(open_blocks):
            rest = _leaders_of_rest(open_blocks, sets, marks, threshold)
            found = rest if found is None else found.unionByName(rest)
            break
        smallest = open_blocks.groupBy("value").agg(F.min("rep").alias("low"))
        marked = open_blocks.join(smallest, "value")
        heads = marked.groupBy("rep").agg(F.min((F.col("rep") == F.col("low")).cast("int")).alias("all_low"))
        new = heads.where("all_low = 1").select("rep")
        pairs = (
            marked.where("rep <> low")
            .join(new.select(F.col("rep").alias("low")), "low", "left_semi")
            .select(F.col("low").alias("a"), F.col("rep").alias("b"))
            .distinct()
        )
        joined = _verified(pairs, sets, marks, threshold, strict=True).select(F.col("b").alias("rep"))
        decided = settle(
            new.select("rep", F.lit(True).alias("is_leader"))
            .unionByName(joined.distinct().select("rep", F.lit(False).alias("is_leader")))
        )
        found = decided if found is None else found.unionByName(decided)
        before, open_blocks = open_blocks, settle(open_blocks.join(decided, "rep", "left_anti"))
        if before is not blocks:
            release(before)
        # blocks of mutually dissimilar sets do not shrink in rounds; their pairs are listed instead
        with cleaned(df.sparkSession):
            slow = decided.count() * 64 < open_blocks.select("rep").distinct().count()
    lead = found.where("is_leader").select("rep")
    rest = found.where("not is_leader").select("rep")
    # every member meets only leaders, which are dissimilar to each other
    lead_blocks = blocks.join(lead, "rep", "left_semi").select(F.col("rep").alias("a"), "value")
    rest_blocks = blocks.join(rest, "rep", "left_semi").select(F.col("rep").alias("b"), "value")
    candidates = rest_blocks.join(lead_blocks, "value").where("a < b").select("a", "b").distinct()
    best = best_per_key(
        _verified(candidates, sets, marks, threshold, strict=True), ["b"], [F.desc("similarity"), F.asc("a")]
    ).select(F.col("b").alias("rep"), F.col("a").alias("leader"), "similarity")
    assigned = best.unionByName(lead.select("rep", F.col("rep").alias("leader"), F.lit(1.0).alias("similarity")))
    # an empty set is similar to nothing, so its rows lead themselves
    out = members.join(assigned, "rep", "left")
    alone = F.col("leader").isNull()
    return out.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("leader")).alias("leader"),
        F.when(alone, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
    )


def _pairs_affordable(open_blocks: DataFrame, factor: int = 64) -> bool:
    """Whether listing the pairs of all blocks costs at most ``factor`` rows per block row."""
    sizes = open_blocks.groupBy("value").agg(F.count("*").cast("double").alias("n"))
    with cleaned(open_blocks.sparkSession):
        one = sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    return one["rows"] is None or one["pairs"] <= factor * one["rows"]


def _leaders_of_rest(open_blocks: DataFrame, sets: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Exact finish over small blocks.

    The similar pairs among the still open sets are listed once, then a set is settled as soon as
    all its earlier neighbours are.
    """
    other = open_blocks.select(F.col("rep").alias("a"), "value")
    pairs = (
        open_blocks.withColumnRenamed("rep", "b").join(other, "value").where("a < b").select("a", "b").distinct()
    )
    edges = settle(_verified(pairs, sets, marks, threshold, strict=True).select("a", "b"))
    state = settle(open_blocks.select("rep").distinct().withColumn("is_leader", F.lit(None).cast("boolean")))
    while True:
        seen = edges.join(state.select(F.col("rep").alias("a"), F.col("is_leader").alias("a_lead")), "a")
        votes = seen.groupBy(F.col("b").alias("rep")).agg(
            F.max(F.coalesce(F.col("a_lead"), F.lit(False)).cast("int")).alias("has_leader"),
            F.max(F.col("a_lead").isNull().cast("int")).alias("has_open"),
        )
        before, state = state, settle(
            state.join(votes, "rep", "left").select(
                "rep",
                F.when(F.col("is_leader").isNotNull(), F.col("is_leader"))
                .when(F.coalesce(F.col("has_leader"), F.lit(0)) == 1, F.lit(False))
                .when(F.coalesce(F.col("has_open"), F.lit(0)) == 0, F.lit(True))
                .alias("is_leader"),
            )
        )
        release(before)
        if state.where("is_leader is null").isEmpty():
            release(edges)
            return state
