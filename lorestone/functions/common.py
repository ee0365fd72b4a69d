"""Small Column helpers shared by the text functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate an expression once per row and use it several times in ``body``.

    Inside array functions a repeated sub-expression is evaluated again for every element; a bound
    variable is not.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Remove white space, including line ends, from both sides."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL when there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def contains_any(lowered: Column, words: list[str]) -> Column:
    """Whether an already lower-cased text contains one of the words."""
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def plain(c: Column) -> Column:
    """Whether a text has ASCII characters only; patterns with and without the flag for Unicode classes are then the same."""
    return F.length(c) == F.octet_length(c)


def _unflagged(pattern: str) -> str:
    flags, rest = re.fullmatch(r"(?s)\(\?([a-zA-Z]+)\)(.*)", pattern).groups()
    low = flags.replace("U", "")
    return (f"(?{low})" if low else "") + rest


def by_letters(is_plain: Column, pattern: str, found: Callable[[str], Column]) -> Column:
    """``found(pattern)``, for plain texts without the flag, whose classes and word ends cost several times as much."""
    return F.when(is_plain, found(_unflagged(pattern))).otherwise(found(pattern))


def by_text(c: Column, found: Callable[[Callable[[str], str]], Column]) -> Column:
    """An expression over several such patterns of one text; ``found`` gets what to do with each pattern."""
    return F.when(plain(c), found(_unflagged)).otherwise(found(lambda pattern: pattern))


def literal_starts(pattern: str) -> list[str]:
    """What the alternatives of a pattern begin with, up to the first sign that is no plain character."""
    inner = re.fullmatch(r"\(\?:(.*)\)[^()]*", pattern, re.S)
    if inner and _balanced(inner[1]):
        pattern = inner[1]
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            parts.append(pattern[last:i])
            last = i + 1
    parts.append(pattern[last:])
    # a character before ?, * or { may be absent
    return [re.match(r"(?:[^\\()\[\].?*+{|^$](?![?*{]))*", p)[0] for p in parts]


def _balanced(text: str) -> bool:
    depth = 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            return False
    return not depth


def may_match(c: Column, lowered: Column, pattern: str, is_plain: Column | None = None) -> Column:
    """Whether a text can match a case-insensitive pattern at all: a cheap test before a costly one.

    Lower-casing does not turn every letter into the one it equals for the pattern, so texts with such letters pass.
    ``is_plain`` tells that there are none, if it is known.
    """
    starts = list(dict.fromkeys(literal_starts(pattern)))
    if min(len(x) for x in starts) < 3:
        return c.rlike("(?iUd)" + pattern) if is_plain is None else by_letters(is_plain, "(?iUd)" + pattern, c.rlike)
    if is_plain is None:
        return contains_any(lowered, starts) | contains_any(c, ["\u017f", "\u0131", "\u0130"])
    return contains_any(lowered, starts) | ~is_plain


def rule_chain(rules: list[tuple[str, Column]], default: str) -> Column:
    """First label whose condition holds."""
    out = None
    for label, cond in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def str_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def set_of(tokens: Column) -> Column:
    return F.array_distinct(tokens)


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct values in both arrays."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 when both are empty."""
    def ratio(common):
        union = F.size(a) + F.size(b) - common
        return F.when(union > 0, common / union).otherwise(F.lit(0.0))

    return let(overlap(a, b), ratio)


def spans(c: Column, pattern: str) -> Column:
    """All matches with their 0-based bounds: array<struct<text,start,stop>>.

    The text between the matches and the matches themselves tile the input, so running sums of
    their lengths are the offsets.
    """
    none = F.array().cast("array<struct<text:string,start:int,stop:int>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(x["hit"].alias("text"), start.alias("start"), stop.alias("stop"))
        grown = F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when(x["hit"].isNull(), acc).otherwise(grown)

    def tile(hits):
        folded = F.aggregate(
            F.arrays_zip(F.split(c, pattern, -1).alias("gap"), hits.alias("hit")),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            add,
            lambda acc: acc["out"],
        )
        return F.when(F.size(hits) == 0, none).otherwise(folded)

    return let(extract_all(c, pattern), tile)


def window_text(c: Column, start: Column, stop: Column) -> Column:
    """Text from start (clamped at 0) up to stop, 0-based and half open."""
    low = F.greatest(start, F.lit(0))
    return F.substring(c, low + 1, F.greatest(stop - low, F.lit(0)))


def token_hits(tokens: Column, window: Column) -> Column:
    """How many of the tokens occur in the window."""
    return F.size(F.filter(tokens, lambda t: window.contains(t)))


def words3(c: Column) -> Column:
    """Distinct lower-case words of three or more characters."""
    return F.array_distinct(extract_all(F.lower(c), r"(?U)\w{3,}"))


def iso_date(c: Column) -> Column:
    """A valid yyyy-MM-dd prefix as date, else NULL."""
    return F.try_to_date(first_match(c, r"^\d{4}-\d{2}-\d{2}"), "yyyy-MM-dd")
