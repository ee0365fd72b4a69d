"""Best-fit packing of token sequences, planned on the histogram of their lengths.

The plan is made over (length, count) pairs, of which there are at most as many as a sequence has
tokens, so it costs the driver the same at any size of the corpus.  Documents then take the planned
slots: each has a rank among the pieces of its length, and the plan says for ranges of ranks which
sequences and which offset they get.

Defined results: a null text is empty and has the end token only, so it is one piece of length 1.
Repeated rows and repeated or null ids are packed like any other rows.  Texts of any length are cut
into full pieces behind one shorter first piece.  An empty table gives no rows.  Columns of the
input beyond id and text are not looked at and may have any names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import mixed, table
from .registry import query

#: texts with a longer run of one kind of character go to the tokenizer whose cost stays near linear in a run
LONG_RUN = 5_000
#: pieces that one part of a length holds on average; ranks are counted part by part
PART_PIECES = 200_000
_PARTS = 1 << 22

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("salt", T.LongType()),
])
PACKED = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A function from text to token ids.

    ``vocabulary`` is a tokenizer file (.json).  Where a rank file (.tiktoken) of the same vocabulary
    lies beside it, that library encodes the ordinary texts, several times as fast to the same ids.
    A text that holds an added token goes to the tokenizer itself, which gives that token's id.
    """
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
    run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added) or (len(text) >= LONG_RUN and run.search(text)):
            return slow(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def pieces(docs: DataFrame, vocabulary: str, most: int, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of each document: (doc_id, piece, start, length, ids_crc32, salt)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % most or min(most, len(ids))
                for k, at in enumerate((0, *range(first, len(ids), most))):
                    part = ids[at: first if k == 0 else at + most]
                    doc.append(key)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            salt = mixed(np.arange(len(doc), dtype=np.uint64) + np.array([hash((d, k)) & 0xFFFFFFFF for d, k in zip(doc, piece, strict=True)], np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array((salt >> np.uint64(34)).astype(np.int64))],
                names=PIECES.names,
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, number, first sequence, offset).

    Pieces of a length with ranks from the first one on go to consecutive sequences from the first
    one on, at that offset.  Open sequences with equal room are one group, so one step places as many
    pieces as the tightest group has sequences.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, number)
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        fitting = sorted(r for r in room if r >= length)
        while left:
            while fitting and not room.get(fitting[0]):
                fitting.pop(0)
            if fitting:
                space = fitting[0]
                first, number = room[space].pop()
                if number > left:
                    room[space].append((first + left, number - left))
                    number = left
            else:
                # each new sequence takes the pieces of this length that it can hold
                each = most // length
                space, number = most, max(1, left // each)
                first, opened = opened, opened + number
            slots.append((length, rank, number, first, most - space))
            rank, left = rank + number, left - number
            rest = space - length
            if rest:
                room.setdefault(rest, []).append((first, number))
                if rest >= length:
                    fitting = sorted({*fitting, rest})
    return slots


def place(found: DataFrame, most: int) -> DataFrame:
    """Give every piece of a settled piece table its sequence and offset."""
    spark = found.sparkSession
    lengths = [(r["length"], 1 + r["n"] // PART_PIECES) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most one row per length
    parts = spark.createDataFrame(lengths, "length long, parts long")
    dealt = found.join(parts, "length").select(*PIECES.names[:5], F.pmod("salt", "parts").cast("int").alias("part"))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a row for each length, and one more for every PART_PIECES pieces
    known = np.array([tuple(r) for r in sizes.orderBy("length", "part").collect()], np.int64).reshape(-1, 3)
    totals: dict[int, int] = {}
    begins = np.zeros(len(known), np.int64)
    for i, (length, _, n) in enumerate(known.tolist()):
        begins[i] = totals.get(length, 0)
        totals[length] = int(begins[i]) + n
    keys = known[:, 0] * _PARTS + known[:, 1]
    slots = np.array(sorted(plan(totals, most)), np.int64).reshape(-1, 5)
    lowest = slots[:, 0] * (1 << 42) + slots[:, 1]  # a length has fewer than 2**42 pieces

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = -1, 0
        for batch in batches:
            length, part = batch.column(3).to_numpy(), batch.column(5).to_numpy().astype(np.int64)
            key = length * _PARTS + part
            if not len(key):
                continue
            # rows come sorted by (length, part), so a rank is the distance from the start of its run
            change = np.concatenate([[key[0] != at], key[1:] != key[:-1]])
            index = np.arange(len(key))
            since = np.maximum.accumulate(np.where(change, index, -1))
            within = np.where(since < 0, count + index, index - since)
            at, count = int(key[-1]), int(within[-1]) + 1
            rank = begins[np.searchsorted(keys, key)] + within
            slot = np.searchsorted(lowest, length * (1 << 42) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slots[slot, 3] + rank - slots[slot, 1]), pa.array(slots[slot, 4])], names=PACKED.names
            )

    return (
        dealt.repartition("length", "part").sortWithinPartitions("length", "part", "doc_id", "piece", "start", "ids_crc32")
        .mapInArrow(seat, PACKED)
    )


def pack(docs: DataFrame, vocabulary: str, most: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``most`` tokens.

    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return place(settle(pieces(docs, vocabulary, most, end_id, id_column, text_column)), most)


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
