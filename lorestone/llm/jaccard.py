"""Jaccard join on sets of word shingles with prefixes of token combinations.

A token is a 64-bit hash of a shingle.  All documents order their tokens alike: by the class of the
token (the binary logarithm of its count, rare ones first), then by hash.  Two sets that reach the
similarity share at least two tokens in their prefixes when these are extended by one.  Therefore
either a rare token is shared, and every rare token of a prefix is indexed by itself, or two frequent
ones are, and pairs of frequent tokens are indexed.  Sets above ``COMBINED`` tokens would have too many
such pairs; they index frequent tokens by themselves.  Sets near that size do both, so no pair of
sets falls between.

Counts are lossy: tokens repeated within a task are counted over all tasks.  They only choose the order,
which may be any, and are kept as one byte per hash bucket.  Equal sets are folded first.

Most keys occur once in the corpus.  Tasks pack their keys, sorted, into one row per hash range, and what is
shuffled is 9 bytes a key (13 where ids lie far apart); a range then gives only the keys that several documents have (``meetings``).  Of these
a small block gives all its pairs.  A larger one is first compared with a few of its members, and what these
already connect is not compared again; all pairs across components that are left are, by tiles of a block and
their marks in arrays, and only what these leave possible becomes a row.  Pairs are first held
against an exact bound from parity bits of each set, about as many as it has tokens, which rules out nearly all others
than links.  Every link is verified on whole sets; only the sets of the pairs that are left are made again from the text.

Defined results: a null text and one without words have the empty set, which links with nothing; fewer
words than a shingle has are one shingle.  Repeated rows are equal sets.  Rows with null id take
part, but are nobody's smallest id.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import components
from ..plans.scale import growing
from ..session import cleaned, release, settle
from .common import free_name, lists, mixed, steps, table, utf8, word_bounds, word_hashes
from .registry import query

#: tokens counted this often are frequent
FREQUENT = 32
#: sets up to this size index pairs of frequent tokens
COMBINED = 96
#: classes of tokens are kept for 2**CLASS_BITS hash buckets, a byte each
CLASS_BITS = 22
#: tokens of a task that are counted together
COUNTED = 1 << 22
#: hash ranges that keys are sorted into
RANGE_BITS = 10
#: keys that a task packs together
PACKED = 1 << 20
#: blocks up to this size give all their pairs at once
SMALL = 6
#: members of a block that one group compares with each other, by their marks
TILE = 1024
#: rounds in which each block is compared with one member
ROUNDS = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of every text."""
    data, offsets = utf8(column)
    marks = _STEP * np.arange(1, width + 1, dtype=np.uint64)
    for a, b in steps(offsets):
        low = offsets[a]
        part = data[low: offsets[b]]
        starts, ends, before = word_bounds(part, offsets[a: b + 1] - low)
        hashes = word_hashes(part, starts, ends)
        for i in range(b - a):
            words = hashes[before[i]: before[i + 1]]
            k = min(width, len(words))
            if not k:
                yield words
                continue
            joined = np.zeros(len(words) - k + 1, np.uint64)
            for j in range(k):
                joined = mixed(joined + words[j: len(words) - k + 1 + j] + marks[j])
            yield np.unique(joined)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _marks(tokens: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens in each of as many hash classes as there are tokens, to the next power of two, as longs."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    place = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def measured(docs: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, n, fp1, fp2, marks) per document: set size, fingerprint, parity marks; and rows (token, hits) of tokens repeated in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("marks", pa.list_(pa.int64())), ("token", pa.int64()), ("hits", pa.int64())])

        def row(**columns):
            rows = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        def repeated():
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()
            at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            n = np.diff(np.append(at, len(tokens)))
            keep = n > 1
            return row(token=pa.array(tokens[at[keep]].view(np.int64)), hits=pa.array(n[keep]))

        for batch in batches:
            sizes, one, two, marks = [], [], [], []
            for tokens in shingle_sets(batch.column(1), width):
                sizes.append(len(tokens))
                one.append(int(np.bitwise_xor.reduce(mixed(tokens + _STEP))) if len(tokens) else 0)
                two.append(int(mixed(tokens ^ _STEP).sum(dtype=np.uint64)) if len(tokens) else 0)
                marks.append(_marks(tokens))
                held.append(tokens)
                size += len(tokens)
                if size > COUNTED:
                    yield repeated()
                    size = 0
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            borders = np.concatenate([[0], np.cumsum([len(m) for m in marks], dtype=np.int64)])
            flat = np.concatenate([*marks, np.zeros(0, np.int64)])
            yield row(doc_id=batch.column(0), n=pa.array(sizes, pa.int64()), fp1=as_long(one), fp2=as_long(two), marks=lists(flat, borders))
        if size:
            yield repeated()

    return docs.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, marks array<long>, token long, hits long")


def token_classes(repeated: DataFrame) -> np.ndarray:
    """One byte per hash bucket: 0 for rare, else the logarithm of the largest count in it."""
    counts = repeated.groupBy("token").agg(F.sum("hits").alias("n")).where(F.col("n") >= FREQUENT)
    best = counts.groupBy(F.shiftrightunsigned("token", 64 - CLASS_BITS).alias("bucket")).agg(F.max("n").alias("n"))
    with cleaned(repeated.sparkSession):
        found = best.toArrow()  # at most 2**CLASS_BITS rows
    classes = np.zeros(1 << CLASS_BITS, np.uint8)
    classes[found.column("bucket").to_numpy()] = np.log2(found.column("n").to_numpy().astype(float)).astype(np.uint8)
    return classes


def index_keys(tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set."""
    n = len(tokens)
    if not n:
        return tokens
    kept = min(n, n - -(-percent * n // 100) + 2)
    kind = classes[_bucket(tokens)]
    order = np.lexsort((tokens, kind))[:kept]
    first, often = tokens[order], kind[order] > 0
    common = first[often]
    parts = [first[~often]]
    # a set of two tokens or fewer may share only one
    if n > COMBINED or kept < 2 or n <= 2:
        parts.append(common)
    if 100 * COMBINED >= percent * n and n > 1:
        i, j = np.triu_indices(len(common), 1)
        low, high = np.minimum(common[i], common[j]), np.maximum(common[i], common[j])
        parts.append(mixed(low * _STEP + mixed(high)))
    return np.concatenate(parts)


def _id_buckets(ids: DataFrame) -> np.ndarray:
    """The hash buckets that hold one of the ids, as bits."""
    with cleaned(ids.sparkSession):
        found = ids.toDF("id").select(_id_bucket("id").alias("b")).distinct().toArrow()  # at most 2**CLASS_BITS rows
    held = np.zeros(1 << CLASS_BITS, bool)
    held[found.column("b").to_numpy()] = True
    return np.packbits(held)


def _id_bucket(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << CLASS_BITS)).cast("long")


def _has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _level(sizes: np.ndarray) -> np.ndarray:
    """Sixteen levels for each doubling of a size, the last one for all larger sizes."""
    return np.minimum(16 * np.log2(sizes), 255).astype(np.uint8)


def packed_keys(docs: DataFrame, classes, copies, width: int, percent: int) -> DataFrame:
    """(place, base, keys, ids, levels) per hash range and some documents: keys as sorted unsigned 32-bit numbers, ids as offsets to base, a byte for the size of each set.

    Documents in the id buckets ``copies`` are passed over; null ids stand for no set.
    """

    def packed(keys: list[np.ndarray], ids: list[int], sizes: list[int]) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        found = np.concatenate(keys)
        order = np.argsort(found)
        found, row = found[order], row[order]
        who, levels = np.array(ids, np.int64)[row], _level(np.array(sizes))[row]
        low, high = int(who.min()), int(who.max())
        offsets = (who - low).astype(np.uint32) if high - low < 1 << 32 else who
        base = low if high - low < 1 << 32 else 0
        place = (found >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
        short = (found >> np.uint64(32 - RANGE_BITS)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends = np.append(at[1:], len(found))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(place[at]), pa.array(np.full(len(at), base)), cut(short), cut(offsets), cut(levels)], names=["place", "base", "keys", "ids", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, passed = classes.value, copies.value
        keys, ids, sizes, size = [], [], [], 0
        for batch in batches:
            batch = batch.filter(pa.array(~_has_bit(passed, batch.column(2).to_numpy())))
            for who, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                if not len(tokens):
                    continue
                keys.append(index_keys(tokens, known, percent))
                ids.append(who)
                sizes.append(len(tokens))
                size += len(keys[-1])
                if size > PACKED:
                    yield packed(keys, ids, sizes)
                    keys, ids, sizes, size = [], [], [], 0
        if size:
            yield packed(keys, ids, sizes)

    named = docs.where("doc_id is not null").select("doc_id", "text", _id_bucket("doc_id").alias("bucket"))
    return named.mapInArrow(run, "place long, base long, keys binary, ids binary, levels binary")


def _met(part: pa.Table, reach: int) -> pa.Table:
    """Of the keys of a hash range that several documents have: pairs (src, dst) of small blocks, members (key, src) of larger ones.

    Pairs have sizes at most ``reach`` levels apart.
    """
    columns = [part.column(i).to_pylist() for i in range(5)]
    keys, ids = [], []
    for base, some, offsets in zip(*columns[1:4], strict=True):
        keys.append(np.frombuffer(some, np.uint32))
        ids.append(base + np.frombuffer(offsets, np.uint32 if len(offsets) == len(some) else np.int64).astype(np.int64))
    found, who, levels = np.concatenate(keys), np.concatenate(ids), np.frombuffer(b"".join(columns[4]), np.uint8).astype(np.int16)
    order = np.lexsort((levels, who, found))
    found, who, levels = found[order], who[order], levels[order]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (who[1:] != who[:-1]) | (levels[1:] != levels[:-1])])
    found, who, levels = found[new], who[new], levels[new]
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    members = np.diff(np.append(at, len(found)))
    sources, targets = [], []
    for m in range(2, SMALL + 1):
        i, j = np.triu_indices(m, 1)
        one, other = ((at[members == m][:, None] + x).ravel() for x in (i, j))
        near = (abs(levels[one] - levels[other]) <= reach) & (who[one] != who[other])
        sources.append(who[one[near]])
        targets.append(who[other[near]])
    pairs = np.unique(np.stack([np.concatenate(sources), np.concatenate(targets)]), axis=1)
    large = np.repeat(members, members) > SMALL
    key = (columns[0][0] << 32) + found[large].astype(np.int64)
    many, n = len(key), pairs.shape[1]
    return pa.table({
        "key": pa.concat_arrays([pa.array(key, pa.int64()), pa.nulls(n, pa.int64())]),
        "src": pa.concat_arrays([pa.array(who[large], pa.int64()), pa.array(pairs[0], pa.int64())]),
        "dst": pa.concat_arrays([pa.nulls(many, pa.int64()), pa.array(pairs[1], pa.int64())]),
    })


def meetings(docs: DataFrame, classes, copies, width: int, percent: int) -> DataFrame:
    """(key, src, dst): pairs without key of documents that share a key with few others, and else (key, src) of each that has the key."""
    reach = math.floor(16 * math.log2(100 / percent)) + 1
    return packed_keys(docs, classes, copies, width, percent).groupBy("place").applyInArrow(lambda part: _met(part, reach), "key long, src long, dst long")


def _within(marks: pa.Array, n: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether the marks of the sets at ``one`` and ``other`` leave it possible that they reach the similarity."""
    flat, at = marks.flatten().to_numpy().view(np.uint64), marks.offsets.to_numpy()
    at = at - at[0]
    longs = np.diff(at).astype(np.int64)
    apart = np.zeros(len(one), np.int64)
    code = (longs[one] << 32) + longs[other]
    for c in np.unique(code).tolist():
        low = min(c >> 32, c & 0xFFFFFFFF)
        rows = np.flatnonzero(code == c)
        for k in range(0, len(rows), 1 << 13):
            some = rows[k: k + (1 << 13)]
            # the classes of the larger set are parts of those of the smaller one
            left, right = (np.bitwise_xor.reduce(flat[at[x[some]][:, None] + np.arange(size)].reshape(len(some), -1, low), axis=1) for x, size in ((one, c >> 32), (other, c & 0xFFFFFFFF)))
            apart[some] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    total = n[one] + n[other]
    return (100 + percent) * (total - apart) >= 2 * percent * total


def _tiled(part: pa.Table, percent: int) -> pa.Table:
    """The pairs across components, within a block or between two tiles of one, that sizes and marks leave possible."""
    key, rep, component, n, tile, low, high = (part.column(c).to_numpy() for c in ("key", "rep", "component", "n", "tile", "lo", "hi"))
    marks = part.column("marks").combine_chunks()
    order = np.argsort(key, kind="stable")
    borders = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
    one, other = [], []
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        left = right = order[a:b]
        if low[0] < high[0]:
            left, right = left[tile[left] == low[0]], right[tile[right] == high[0]]
        small, large = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
        i, j = np.nonzero((100 * small >= percent * large) & np.not_equal.outer(component[left], component[right]))
        left, right = left[i], right[j]
        # within one tile every pair is met twice
        once = slice(None) if low[0] < high[0] else left < right
        one.append(left[once])
        other.append(right[once])
    one, other = np.concatenate(one), np.concatenate(other)
    held = _within(marks, n, one, other, percent)
    one, other = rep[one[held]], rep[other[held]]
    pairs = np.unique(np.stack([np.minimum(one, other), np.maximum(one, other)]), axis=1)
    return pa.table({"src": pa.array(pairs[0], pa.int64()), "dst": pa.array(pairs[1], pa.int64())})


def _across(labelled: DataFrame, open_: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """All pairs across components that the blocks left open hold and the marks leave possible.

    Small blocks of a hash range are compared in one group, large ones by pairs of tiles.
    """
    rows = labelled.join(open_.select("key", F.ceil(F.col("members") / TILE).alias("tiles")), "key").join(growing(reps), "rep")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    place = lambda part, lo, hi: F.struct(part.alias("part"), lo.alias("lo"), hi.alias("hi"))
    alone = F.array(place(F.shiftright("key", 32), F.lit(-1).cast("long"), F.lit(-1).cast("long")))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda u: place(F.col("key"), F.least("tile", u), F.greatest("tile", u)))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("tiles") == 1, alone).otherwise(tiles)))
    dealt = dealt.select("at.*", "key", "rep", "component", "n", "tile", "marks")
    return dealt.groupBy("part", "lo", "hi").applyInArrow(lambda part: _tiled(part, percent), "src long, dst long")


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs of representatives that their marks do not rule out: a mark that differs proves a token that only one of them has."""
    side = lambda node, x: reps.select(F.col("rep").alias(node), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}"))
    both = pairs.join(growing(side("src", "a")), "src").join(growing(side("dst", "b")), "dst")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("src", "dst", "n_a", "n_b", "m_a", "m_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.concat_arrays([batch.column(4), batch.column(5)])
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            at = np.arange(batch.num_rows)
            yield batch.select(["src", "dst"]).filter(pa.array(_within(marks, n, at, at + batch.num_rows, percent)))

    return both.mapInArrow(run, "src long, dst long").distinct()


def _sets(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(rep, tokens) of the documents whose bucket holds an id of a pair, so that others are not shuffled; the joins are exact anyway."""
    bits = docs.sparkSession.sparkContext.broadcast(_id_buckets(pairs.select(F.explode(F.array("src", "dst")))))

    def made(ids: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        borders = np.concatenate([[0], np.cumsum([len(k) for k in held], dtype=np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(np.concatenate(held).view(np.int64), borders)], names=["rep", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_has_bit(bits.value, batch.column(2).to_numpy())))
            held, ids, size = [], [], 0
            for who, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                held.append(tokens)
                ids.append(who)
                size += len(tokens)
                if size > PACKED:
                    yield made(ids, held)
                    held, ids, size = [], [], 0
            if held:
                yield made(ids, held)

    named = docs.where("doc_id is not null").select("doc_id", "text", _id_bucket("doc_id").alias("bucket"))
    # repeated rows of an id are one set
    return named.mapInArrow(run, "rep long, tokens array<long>").dropDuplicates()


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (src, dst) whose sets reach the similarity."""
    sets = settle(_sets(docs, pairs, width))
    left = sets.select(F.col("rep").alias("src"), F.col("tokens").alias("a"))
    right = sets.select(F.col("rep").alias("dst"), F.col("tokens").alias("b"))
    both = pairs.join(growing(left), "src").join(growing(right), "dst").withColumn("same", F.size(F.array_intersect("a", "b")))
    links = settle(both.where(100 * F.col("same") >= percent * (F.size("a") + F.size("b") - F.col("same"))).select("src", "dst").distinct())
    release(sets)
    return links


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows with the component of their representative."""
    if labels is None:
        return rows.withColumn("component", F.col("rep"))
    named = labels.select(F.col("node").alias("rep"), F.col("component").alias("linked"))
    return rows.join(growing(named), "rep", "left").withColumn("component", F.coalesce("linked", "rep")).drop("linked")


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    first = settle(measured(plain, width))
    classes = spark.sparkContext.broadcast(token_classes(first.where("token is not null").select("token", "hits")))  # 2**CLASS_BITS bytes
    found = first.where("n is not null").select("doc_id", "n", "fp1", "fp2", "marks")
    # one document stands for all with the same set
    folded = found.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"))
    whole = found.join(growing(folded), ["fp1", "fp2", "n"], "left")
    named = settle(whole.select("doc_id", "n", "rep"))
    # an id may be repeated with different texts; then its sets are told apart by fingerprint
    reps = settle(whole.where("doc_id = rep").dropDuplicates(["rep", "fp1", "fp2", "n"]).select("rep", "n", "marks"))
    # ids of nothing but copies; a bucket may hold several ids
    copies = spark.sparkContext.broadcast(_id_buckets(named.where("doc_id <> rep").select("doc_id")) & ~_id_buckets(reps.select("rep")))
    met = settle(meetings(plain, classes, copies, width, percent))
    release(first)
    members = met.where("key is not null").select("key", F.col("src").alias("rep"))
    blocks = settle(members.join(growing(reps.select("rep")), "rep", "left_semi"))
    # of the linked representatives; all others are by themselves
    labels: DataFrame | None = None
    links: DataFrame | None = None
    tried: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        labelled = _labelled(blocks, labels)
        leader = F.min_by(F.struct("rep", "component"), F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep"))
        open_ = labelled.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), leader.alias("l")
        ).where("lo < hi").select("key", "members", "l")
        if turn < ROUNDS:
            near = labelled.join(open_, "key").where("component <> l.component").select("rep", F.col("l.rep").alias("other"))
            pairs = near.select(F.least("rep", "other").alias("src"), F.greatest("rep", "other").alias("dst"))
        else:
            pairs = _across(labelled, open_, reps, percent)
        if not turn:
            pairs = pairs.unionByName(met.where("key is null").select("src", "dst"))
        pairs = pairs.distinct() if tried is None else pairs.distinct().join(tried, ["src", "dst"], "left_anti")
        pairs = settle(_possible(pairs, reps, percent) if turn < ROUNDS else pairs)
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = _linked(pairs, plain, width, percent)
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        labels = components(links.select(F.explode(F.array("src", "dst")).alias("node")), links)
    return _labelled(named, labels).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """The rows whose id is the smallest of its group, one row per id and text."""
    groups = jaccard_groups(docs, **options)
    kept = free_name(docs, "_kept_id")
    keep = groups.where("component_id = doc_id").select(F.col("doc_id").alias(kept)).distinct()
    # the join comes first, so that rows of one id lie together and only what stays is folded
    named = docs.join(keep, F.col("doc_id") == F.col(kept), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


@query("op9_jaccard")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(table(spark, folder, "documents"))
