"""Similarity of strings by matching blocks: twice the characters in common blocks over all characters.

The longest common block is found first, the leftmost one on a tie, then the longest ones before and after it, and so on.  In
a second string of 200 characters and more, those that make up over a hundredth of it start no block, though they
extend one.

Two bounds spare most of the work where only a limit matters: blocks hold at most the shorter string, and no more of each
character than both strings have.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

#: from this length on, frequent characters start no block
LONG = 200


def _ratio(common: int, a: str, b: str) -> float:
    return 2.0 * common / (len(a) + len(b)) if a or b else 1.0


def bound_by_length(a: str, b: str) -> float:
    return _ratio(min(len(a), len(b)), a, b)


def bound_by_characters(a: str, b: str) -> float:
    return _ratio((Counter(a) & Counter(b)).total(), a, b)


def common_characters(a: str, b: str) -> int:
    """Characters of ``a`` and ``b`` in matching blocks."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, ch in enumerate(b):
        places[ch].append(j)
    if len(b) >= LONG:
        most = len(b) // 100 + 1
        places = {ch: js for ch, js in places.items() if len(js) <= most}
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        at, bt, size = a0, b0, 0
        ending: dict[int, int] = {}
        for i in range(a0, a1):
            now = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    n = now[j] = ending.get(j - 1, 0) + 1
                    if n > size:
                        at, bt, size = i - n + 1, j - n + 1, n
            ending = now
        # frequent characters may extend a block on both sides
        while at > a0 and bt > b0 and a[at - 1] == b[bt - 1]:
            at, bt, size = at - 1, bt - 1, size + 1
        while at + size < a1 and bt + size < b1 and a[at + size] == b[bt + size]:
            size += 1
        if size:
            total += size
            todo += [(a0, at, b0, bt), (at + size, a1, bt + size, b1)]
    return total


def ratio(a: str, b: str) -> float:
    return _ratio(common_characters(a, b), a, b)


def reaches(a: str, b: str, least: float) -> bool:
    """Whether the ratio is at least ``least``; the blocks are sought only where the bounds leave it open."""
    return bound_by_length(a, b) >= least and bound_by_characters(a, b) >= least and ratio(a, b) >= least


def _each(fn, a: pd.Series, b: pd.Series, kind: str) -> pd.Series:
    """``fn`` once for each different pair of the batch; null where a side is null."""
    known: dict[tuple[str, str], object] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = fn(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=kind)


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(ratio, a, b, "float64")


def block_ratio_reaches(a: Column, b: Column, least: float) -> Column:
    """Whether two strings are alike to ``least``; null where one is null, at no cost."""

    @F.pandas_udf(BooleanType())
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        return _each(lambda p, q: reaches(p, q, least), x, y, "object")

    return test(a, b)
