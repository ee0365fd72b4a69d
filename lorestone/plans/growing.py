"""Clusters that grow in order.

A note joins the first cluster, by the place of its first note, that holds at least two of its keys
already; otherwise it opens a cluster.  A cluster's keys are those of all notes that joined it before, so the result
depends on the order.

Only a note that opens a cluster or brings it a new key changes what later notes find.  Some notes, at first those that are the
first with one of their keys, are replayed in order; that says when each key entered each cluster.  With this
every note is placed by itself, in parallel.  If none but the replayed ones opens a cluster or brings a new key, then all are right, by
induction over the order.  Otherwise the first of those that do are replayed too.

Where these are too many to be copied to the tasks, the notes are split: notes without a common key never meet, so each
connected component of notes and keys is replayed by itself.  A component above ``held`` notes is not given to one task but
tried in the first way by itself; if that fails, it is solved by rounds of joins: from an assignment of all notes follows when
each key entered each cluster, and from that a new assignment.  The rule looks only at earlier notes, so
a round makes right at least every note whose earlier notes are right, the right assignment is the only
one that a round leaves as it is, and the rounds end there.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import release, settle
from .graph import components
from .scale import growing

#: keys that a note and a cluster must share
SHARED = 2
#: notes of a component that one task replays
HELD = 200_000
#: keys of the replayed notes that are copied to the tasks, and clusters whose sizes are
COPIED = 1 << 21
#: times that notes are added to the replayed ones, and of these how often only the first for a cluster and key
TURNS, FIRSTS = 12, 4

#: per key the clusters that hold it in order, and since which note
Holders = dict[str, tuple[list[int], list[int]]]


def nearest(seq: int, found: list[tuple[list[int], list[int]]]) -> int | None:
    """The first cluster that held enough keys before ``seq``, from the holders of the keys of a note."""
    # a cluster with two keys holds one that is not the most widely held
    found = sorted(found, key=lambda h: len(h[0]))
    cut = max(0, len(found) - SHARED + 1)
    few, most = found[:cut], found[cut:]
    at = [0] * cut
    while True:
        cluster = min((h[0][i] for h, i in zip(few, at, strict=True) if i < len(h[0])), default=seq)
        if cluster >= seq:
            return None
        n = 0
        for place, (clusters, since) in enumerate(few):
            i = at[place]
            if i < len(clusters) and clusters[i] == cluster:
                n += since[i] < seq
                at[place] = i + 1
        if n < SHARED:
            n += sum(holds(h, cluster, seq) for h in most)
        if n >= SHARED:
            return cluster


def holds(holders: tuple[list[int], list[int]], cluster: int, before: int) -> bool:
    clusters, since = holders
    i = bisect_left(clusters, cluster)
    return i < len(clusters) and clusters[i] == cluster and since[i] < before


def replay(notes: Iterable[tuple[int, list[str]]], holders: Holders | None = None) -> Iterator[tuple[int, int]]:
    """(seq, cluster) of notes in order; a cluster is named by its first note.  ``holders`` is kept up to date."""
    holders = {} if holders is None else holders
    for seq, keys in notes:
        found = [holders.setdefault(k, ([], [])) for k in keys]
        cluster = nearest(seq, found)
        cluster = seq if cluster is None else cluster
        for clusters, since in found:
            i = bisect_left(clusters, cluster)
            if i == len(clusters) or clusters[i] != cluster:
                clusters.insert(i, cluster)
                since.insert(i, seq)
        yield seq, cluster


def _replayed(rows: DataFrame) -> DataFrame:
    """(seq, cluster) from (component, seq, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, part = None, []

        def done() -> pa.RecordBatch:
            out = list(replay(part))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], names=["seq", "cluster"])

        for batch in batches:
            for component, seq, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != here:
                    if part:
                        yield done()
                    here, part = component, []
                part.append((seq, keys))
        if part:
            yield done()

    return rows.select("component", "seq", "keys").repartition("component").sortWithinPartitions("component", "seq").mapInArrow(run, "seq long, cluster long")


def _rounds(held: DataFrame) -> DataFrame:
    """(seq, cluster) from (seq, key, n), n being the notes with that key."""
    # all keys of a note but its most common one: whoever shares two keys shares one of these
    place = F.row_number().over(W.partitionBy("seq").orderBy(F.desc("n"), "key"))
    asked = settle(held.withColumn("rare", place >= SHARED).select("seq", "key", "rare"))
    now = asked.select("seq").distinct().withColumn("cluster", F.col("seq"))
    while True:
        entered = settle(asked.join(growing(now), "seq").groupBy("cluster", "key").agg(F.min("seq").alias("since")))
        near = asked.where("rare").join(growing(entered), "key").where("since < seq and cluster < seq").select("seq", "cluster").distinct()
        shared = asked.select("seq", "key").join(growing(near), "seq").join(growing(entered), ["cluster", "key"]).where("since < seq")
        first = shared.groupBy("seq", "cluster").agg(F.count("*").alias("n")).where(f"n >= {SHARED}").groupBy("seq").agg(F.min("cluster").alias("found"))
        step = settle(now.join(growing(first), "seq", "left").select("seq", F.coalesce("found", "seq").alias("cluster"), F.col("cluster").alias("before")))
        if step.where("cluster <> before").isEmpty():
            return step.select("seq", "cluster")
        now = step.select("seq", "cluster")


def _state(some: DataFrame) -> pa.Table:
    """(key, cluster, since) after the replay of some notes (seq, keys) in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders: Holders = {}
        for batch in batches:
            for _ in replay(zip(*(c.to_pylist() for c in batch.columns), strict=True), holders):
                pass
        rows = [(key, c, s) for key, h in holders.items() for c, s in zip(*h, strict=True)]
        for low in range(0, len(rows), 1 << 16):
            parts = zip(*rows[low : low + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "cluster", "since"])

    return some.select("seq", "keys").repartition(1).sortWithinPartitions("seq").mapInArrow(run, "key string, cluster long, since long").toArrow()


def _placed(notes: DataFrame, state: pa.Table) -> DataFrame:
    """(seq, cluster, fresh, keys) of all notes; a note that changes the state has ``fresh``, the keys it brings, others have nulls there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders: Holders = {}
        # the clusters of a key come in order
        for key, cluster, since in zip(*(c.to_pylist() for c in state.columns), strict=True):
            h = holders.setdefault(key, ([], []))
            h[0].append(cluster)
            h[1].append(since)
        for batch in batches:
            out = []
            for seq, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a key that no replayed note has is of this note only
                known = [k for k in keys if k in holders]
                cluster = nearest(seq, [holders[k] for k in known])
                cluster = seq if cluster is None else cluster
                fresh = [k for k in known if not holds(holders[k], cluster, seq + 1)]
                out.append((seq, cluster, fresh or None, keys if fresh else None))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["seq", "cluster", "fresh", "keys"])

    return notes.select("seq", "keys").mapInArrow(run, "seq long, cluster long, fresh array<string>, keys array<string>")


def _spread(notes: DataFrame, copied: int) -> DataFrame | None:
    """(seq, cluster) of (seq, keys); None if the notes that must be replayed have more than ``copied`` keys."""
    keys = notes.select("seq", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    some = settle(notes.join(keys.where("n > 1").select("seq").distinct(), "seq", "left_semi"))
    for turn in range(TURNS):
        if (some.agg(F.sum(F.size("keys")).alias("n")).first().n or 0) > copied:
            return None
        now = settle(_placed(notes, _state(some)))
        odd = now.where("fresh is not null")
        if odd.isEmpty():
            return now.select("seq", "cluster")
        if turn < FIRSTS:
            # those that would open a cluster count by key alone
            there = F.when(F.col("cluster") < F.col("seq"), F.col("cluster")).alias("cluster")
            first = odd.select("seq", there, F.explode("fresh").alias("key")).groupBy("cluster", "key").agg(F.min("seq").alias("seq"))
            odd = odd.join(first.select("seq").distinct(), "seq", "left_semi")
        before, some = some, settle(some.unionByName(odd.select("seq", "keys")))
        release(before)
        release(now)
    return None


def _by_component(notes: DataFrame, held: int, copied: int) -> DataFrame:
    """(seq, cluster) of (seq, keys) by connected components."""
    pairs = notes.select("seq", F.explode("keys").alias("key"))
    # a key of one note never brings it together with another
    common = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("seq").alias("src")).where("n > 1")
    useful = settle(pairs.join(growing(common), "key"))
    labels = components(useful.select(F.col("seq").alias("node")).distinct(), useful.select("src", F.col("seq").alias("dst")))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    tagged = settle(labels.join(growing(sizes), "component").select(F.col("node").alias("seq"), "component", "size"))
    keyed = useful.join(growing(tagged), "seq")
    small = keyed.where(F.col("size") <= held).groupBy("component", "seq").agg(F.collect_list("key").alias("keys"))
    found = _replayed(small)
    if not tagged.where(F.col("size") > held).isEmpty():
        large = settle(keyed.where(F.col("size") > held).select("seq", "key", "n"))
        spread = _spread(settle(large.groupBy("seq").agg(F.collect_list("key").alias("keys"))), copied)
        found = found.unionByName(_rounds(large) if spread is None else spread)
    return settle(found)


def grown_clusters(notes: DataFrame, held: int = HELD, copied: int = COPIED) -> DataFrame:
    """(seq, cluster, n) of clusters of two and more notes, from (seq, keys) with a unique seq.

    Null keys are no keys, repeated keys count once; notes without keys are in no cluster.
    """
    keys = F.filter(F.array_distinct("keys"), lambda k: k.isNotNull())
    rows = notes.select(F.col("seq").cast("long").alias("seq"), keys.alias("keys")).where("seq is not null")
    # without keys only after the grouping: before it, the optimizer would make the keys once more for the test
    kept = settle(rows.groupBy("seq").agg(F.flatten(F.collect_list("keys")).alias("keys")).where("size(keys) > 0"))
    found = _spread(kept, copied)
    if found is None:
        found = _by_component(kept, held, copied)
    sizes = settle(found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1"))
    # a cluster may have any share of the notes
    sizes = F.broadcast(sizes) if sizes.count() <= copied // 2 else growing(sizes)
    return found.join(sizes, "cluster").select("seq", "cluster", "n")
