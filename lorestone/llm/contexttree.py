"""Scoring texts with context-tree weighting on bytes.

A byte is eight binary decisions, each a node of a binary tree of 255.  For every decision there is a
context tree over the preceding bytes, ``DEPTH`` deep.  The counts of a decision in a context give the
Krichevsky-Trofimov probability of its training bits; going up from the deepest contexts, each node
weighs its own estimate against the product of its children, half each beforehand.  Those weights
mix the estimates of all depths into one probability per decision, hence per (context, byte).
A context that training never saw says nothing: the mix ends at the one above.

Counts come from all training bytes and are summed by Spark; they grow with the corpus.
The trees below each two preceding bytes are independent; tasks weigh them in portions, of which one
tree, at most 256**(DEPTH - 1) rows whatever the corpus, is the smallest.  Texts are scored from their own
(context, byte) counts: tasks hold the table of values while it has at most ``HELD`` rows, beyond that the counts
are joined with it, to the same result.

Texts begin in a context of zero bytes and end with one; A-Z count as a-z.

Defined results: a null text is empty and has its end only.  Repeated rows get equal scores.  Without
training text every byte has probability 1/256.  An empty table gives no rows.  Columns other than
id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import STEP_BYTES, crc_remainder, lowered, table, utf8, word_bounds, word_hashes
from .registry import query

#: bytes of context
DEPTH = 4
#: rows of the table of values that tasks hold (12 bytes each)
HELD = 8_000_000
#: rows of contexts that a task weighs at once
PORTION = 1 << 19
#: key of the end of a text among words
_END = 0x5EED5EED5EED5EED


def grams(raw: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte of a text and its end: the last byte in the highest place, then the ones before, then the byte itself lowest.

    The nearest context byte comes first, so that a context's number is a prefix of those below it.
    """
    s = np.concatenate([np.zeros(depth, np.uint8), lowered(raw), np.zeros(1, np.uint8)]).astype(np.int64)
    n = len(raw) + 1
    key = np.zeros(n, np.int64)
    for d in range(1, depth + 1):
        key = (key << 8) | s[depth - d: depth - d + n]
    return (key << 8) | s[depth:]


def _joined(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with their sums; few sorted runs of keys are merged in linear time."""
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], (np.add.reduceat(sums, first) if len(first) else sums)


class _Totals:
    """Counts of keys within a task: training texts count, the others only bring their keys."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.size = 0

    def add(self, keys: np.ndarray, learned: bool) -> None:
        self.held[learned].append(keys)
        self.size += len(keys)
        if self.size > 2 * STEP_BYTES:
            self.merge()

    def merge(self) -> None:
        runs = [(self.keys, self.sums)]
        for learned, parts in self.held.items():
            if parts:
                key, n = np.unique(np.concatenate(parts), return_counts=True)
                runs.append((key, n if learned else np.zeros(len(key), np.int64)))
        self.keys, self.sums = _joined(*(np.concatenate(x) for x in zip(*runs, strict=True)))
        self.held, self.size = {False: [], True: []}, 0

    def batch(self) -> pa.RecordBatch:
        self.merge()
        out = pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.sums)], names=["key", "n"])
        self.__init__()
        return out


def totals(texts: DataFrame, keys_of) -> DataFrame:
    """(key, n) of every key in the texts (text, learned); n counts the training texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Totals()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            learned = batch.column(1).to_pylist()
            for i, yes in enumerate(learned):
                found.add(keys_of(data[offsets[i]: offsets[i + 1]]), bool(yes))
            if len(found.keys) > 1 << 21:
                yield found.batch()
        yield found.batch()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_keys(raw: np.ndarray) -> np.ndarray:
    """A hash for each word and one for the end of the text."""
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    return np.append(word_hashes(raw, starts, ends).view(np.int64), np.int64(_END))


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones in a known order."""
    from math import lgamma

    g = np.vectorize(lgamma, otypes=[float])
    top = int(max(a.max(initial=0), b.max(initial=0), (a + b).max(initial=0)))
    if top < 1 << 20:
        half = np.concatenate([[0.0], np.cumsum(np.log(np.arange(top) + 0.5))])
        whole = np.concatenate([[0.0], np.cumsum(np.log(np.arange(top) + 1.0))])
        return half[a] + half[b] - whole[a + b]
    return g(a + 0.5) + g(b + 0.5) - g(a + b + 1.0) - 2 * lgamma(0.5)


def _bits(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted decisions (context * 256 + node) with their zeros and ones."""
    keys, zeros, ones = [], [], []
    for i in range(8):
        node = (1 << i) | (byte >> (8 - i))
        bit = (byte >> (7 - i)) & 1
        k, place = np.unique(context * 256 + node, return_inverse=True)
        keys.append(k)
        ones.append(np.bincount(place, n * bit, len(k)).astype(np.int64))
        zeros.append(np.bincount(place, n * (1 - bit), len(k)).astype(np.int64))
    key, a, b = (np.concatenate(x) for x in (keys, zeros, ones))
    order = np.argsort(key)
    return key[order], a[order], b[order]


def _subtree(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Per depth from ``top`` to ``depth`` (decision, p of a one, weight of the own estimate), and ln P_w at ``top``."""
    levels, product = [], None
    for d in range(depth, top - 1, -1):
        key, a, b = _bits(gram >> (8 * (depth - d + 1)), gram & 255, n)
        below = None
        if product is not None:
            # every child has a parent; what has no children below is its own estimate
            up = ((product[0] >> 16) << 8) | (product[0] & 255)
            below = np.bincount(np.searchsorted(key, up), product[1], len(key))
        level, weighted = _weighed(key, a, b, below)
        levels.append(level)
        product = (key, weighted)
    return levels[::-1], product[1]


def _weighed(key: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """((decision, p of a one, weight of the own estimate), ln P_w) of one depth; ``below`` sums ln P_w of the children."""
    own = _kt(a, b)
    one = (b + 0.5) / (a + b + 1.0)
    if below is None:
        return (key, one, np.ones(len(key))), own
    weight = 1.0 / (1.0 + np.exp(np.clip(below - own, -700, 700)))
    return (key, one, weight), np.logaddexp(own, below) - np.log(2.0)


def _by_context(total: DataFrame, high: int, work, shape: str) -> DataFrame:
    """Apply ``work`` (keys, counts -> batch) to rows with whole contexts, a context being the key above ``high`` bits.

    Rows come sorted; a task takes them in portions of at least PORTION rows that end where a context ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size < PORTION:
                continue
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.searchsorted(key, (key[-1] >> high) << high))
            if end:
                yield work(key[:end], n[:end])
            held, size = [(key[end:], n[end:])], len(key) - end
        if size:
            yield work(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return total.select("key", "n").repartition(F.shiftright("key", high)).sortWithinPartitions("key").mapInArrow(run, shape)


def values(total: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, value) for every (context, byte) of all texts: value is log10 of its probability.

    The trees below each two preceding bytes are built twice, first for their weight in the one-byte contexts, then for
    the values.  The contexts of no and one byte are 256 and 65,536 rows at most; the driver weighs them.
    """
    top = min(2, depth)  # depth of the contexts that stay whole
    high = 8 * (depth - top + 1)

    def weigh(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        levels, weighted = _subtree(key[n > 0], n[n > 0], depth, top)
        # decisions of the contexts one byte shorter
        up = ((levels[0][0] >> 16) << 8) | (levels[0][0] & 255)
        node, place = np.unique(up, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.bincount(place, weighted, len(node)))], names=["node", "w"])

    # 256 preceding bytes times 256 bytes
    first = total.where("n > 0").groupBy(F.shiftright("key", 8 * depth).alias("c"), F.col("key").bitwiseAND(255).alias("s")).agg(F.sum("n").alias("n")).toArrow()
    c, s, n = (first.column(x).to_numpy() for x in ("c", "s", "n"))
    below = _by_context(total, high, weigh, "node long, w double").groupBy("node").agg(F.sum("w").alias("w")).toArrow()
    order = np.argsort(below.column("node").to_numpy())
    node, weight = below.column("node").to_numpy()[order], below.column("w").to_numpy()[order]
    upper = []
    for d in range(top - 1, -1, -1):
        key, a, b = _bits(c * d, s, n)
        level, weighted = _weighed(key, a, b, np.bincount(np.searchsorted(key, node), weight, len(key)))
        upper.append(level)
        node, place = np.unique(((key >> 16) << 8) | (key & 255), return_inverse=True)
        weight = np.bincount(place, weighted, len(node))
    upper = upper[::-1]

    def value(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        levels, _ = _subtree(key[n > 0], n[n > 0], depth, top)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(Table(upper + levels, depth).value(key))], names=["key", "n", "value"])

    return _by_context(total, high, value, "key long, n long, value double")


class Table:
    """The decisions of all depths, sorted, which value (context, byte) numbers."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int):
        self.depth, self.levels = depth, levels

    def value(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of the byte in its context."""
        byte, out = gram & 255, np.zeros(len(gram))
        for i in range(8):
            node = (1 << i) | (byte >> (8 - i))
            carry, mix = np.ones(len(gram)), np.zeros(len(gram))
            own, weight = np.full(len(gram), 0.5), np.zeros(len(gram))
            known = np.ones(len(gram), bool)
            for d, (key, ones, weights) in enumerate(self.levels):
                want = ((gram >> (8 * (self.depth - d + 1))) << 8) | node
                at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
                known &= (key[at] == want) if len(key) else False
                # without the next context the mix ends here
                share = np.where(known, weight, 1.0)
                mix += carry * share * own
                carry *= 1.0 - share
                if len(key):
                    own, weight = np.where(known, ones[at], own), np.where(known, weights[at], 1.0)
            mix += carry * own
            out += np.log10(np.where((byte >> (7 - i)) & 1 == 1, mix, 1.0 - mix))
        return out


def summed(docs: DataFrame, table_: DataFrame, keys_of, held: int = HELD) -> DataFrame:
    """(doc_id, digest, n, n_known, total) per different row of ``docs`` (doc_id, digest, text).

    ``table_`` has (key, n, value); a key without a row there, or with n = 0, is unknown.  The texts' own
    counts are joined with it where it has more than ``held`` rows.
    """
    spark = docs.sparkSession
    names = ["doc_id", "digest", "n", "n_known", "total"]
    if table_.count() <= held:
        known = table_.toArrow()  # at most ``held`` rows
        key, n, value = (known.column(x).to_numpy() for x in ("key", "n", "value"))
        order = np.argsort(key)
        model = spark.sparkContext.broadcast((key[order], n[order] > 0, value[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, seen, worth = model.value
            for batch in batches:
                data, offsets = utf8(batch.column(2))
                out = np.zeros((3, batch.num_rows))
                for i in range(batch.num_rows):
                    mine, times = np.unique(keys_of(data[offsets[i]: offsets[i + 1]]), return_counts=True)
                    at = np.searchsorted(keys, mine)  # every key of every text is in the table
                    out[:, i] = times.sum(), times @ seen[at], times @ worth[at]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2])], names=names)

        return docs.mapInArrow(run, "doc_id long, digest long, n long, n_known long, total double").dropDuplicates(["doc_id", "digest"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i in range(batch.num_rows):
                key, n = np.unique(keys_of(data[offsets[i]: offsets[i + 1]]), return_counts=True)
                here = pa.array(np.full(len(key), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(here), batch.column(1).take(here), pa.array(key), pa.array(n)], names=["doc_id", "digest", "key", "times"])

    counted = docs.dropDuplicates(["doc_id", "digest"]).mapInArrow(own, "doc_id long, digest long, key long, times long")
    return counted.join(table_, "key").groupBy("doc_id", "digest").agg(
        F.sum("times").alias("n"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * F.col("value")).alias("total")
    )


def score(docs: DataFrame, learned: Column, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH, held: int = HELD) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every row.

    ``base_score`` is the add-one model of words, ``score`` the context trees', both as log10 of the text's probability.
    """
    plain = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned")
    ).withColumn("digest", F.xxhash64("text"))
    texts = plain.select("doc_id", "digest", "text")
    words = settle(totals(plain.select("text", "learned"), word_keys))
    facts = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    worth = F.log10((F.col("n") + F.lit(1.0)) / F.lit(float(facts["n"] + facts["v"] + 1)))
    base = summed(texts, words.withColumn("value", worth), word_keys, held)
    bytes_of = _Grams(depth)
    total = settle(totals(plain.select("text", "learned"), bytes_of))
    valued = settle(values(total, depth))
    trees = summed(texts, valued, bytes_of, held).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("total").alias("score"), F.col("n").alias("n_bytes"))
    both = base.join(trees, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select(
        F.col("_id"), F.col("_digest"), F.col("n").alias("n_tokens"), "n_known", F.lit(facts["n"]).cast("long").alias("train_tokens"), F.col("total").alias("base_score"), "score", "n_bytes"
    )
    rows = plain.select("doc_id", "digest", "learned")
    return rows.join(both, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).drop("_id", "_digest", "digest")


class _Grams:
    def __init__(self, depth: int) -> None:
        self.depth = depth

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return grams(raw, self.depth)


@query("op10_contexttree")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score(docs, crc_remainder("doc_id", 7) != 2).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
