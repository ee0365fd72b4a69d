"""Helpers of the operators: Arrow text buffers, words and hashes as arrays, tables that may miss columns.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere.  UTF-8 continuation bytes are never white space, so words
are found on the bytes of the Arrow buffer, without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that one step inside a task looks at
STEP_BYTES = 2 << 20
#: pattern of white space between words
SPACES = "[\\x20\\x09-\\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or ``wish`` with underscores where the frame has that column already."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def crc_remainder(column: str, n: int) -> F.Column:
    """crc32 of the column as text, modulo n (0 for null)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n)), F.lit(0)).cast("int")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word in ``data``, and per text the number of words before it.

    ``offsets`` are the borders of the texts within ``data``; no word crosses one.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    before[borders] = False
    after[borders - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in steps(offsets):
        part = data[offsets[a]: offsets[b]]
        out[a:b] = np.diff(word_bounds(part, offsets[a: b + 1] - offsets[a])[2])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, n.bit_length())
            grow = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            cls.up, cls.down = grow(np.uint64(_BASE)), grow(np.uint64(pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, A-Z as a-z if ``lower``."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, low + STEP_BYTES, "right")))
        part = data[low: ends[end - 1]]
        up, down = _Powers.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(((_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        out[at:end] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    return out


def lowered(part: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[part]


def lists(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """A list column from flat values and the borders of the rows."""
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values))
