"""Source code as spans: what is defined where, and who owns it.

One scan over the characters knows which lines begin inside a string, a comment or brackets.  A second pass over the lines
keeps a stack of open definitions: where blocks are indented a definition ends before the next line that is not indented
deeper, where they are braced at the line that closes its brace.  Chunks and symbols are both read off the spans.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import fixed

#: chunks of at most this many characters say too little
SHORT = 30

_INDENTED = re.compile(fixed.INDENTED_DEFINITION)
_BRACED = re.compile(fixed.BRACED_DEFINITION)
_MARKS = {
    "indent": re.compile(r"\"\"\"|'''|\\[^\n]|[\"'#()\[\]{}\n]"),
    "brace": re.compile(r"/\*|\*/|//|\\[^\n]|[\"'`()\[\]{};\n]"),
}
_OPEN, _CLOSE = "([{", ")]}"


@dataclass
class Line:
    text: str
    #: bracket depth at the start, and whether the line starts in a string or comment
    depth: int
    inside: bool
    #: depth at the end, and the lowest and highest depth of braces on the way
    end: int = 0
    opens: bool = False
    ends_statement: bool = False

    @property
    def indent(self) -> int:
        return len(self.text) - len(self.text.lstrip())

    @property
    def starts(self) -> bool:
        """Whether a statement can start here."""
        return not self.inside and bool(self.text.strip())


def style_of(text: str) -> str:
    """Whether blocks are indented or braced, by the definitions that the text holds."""
    return "indent" if any(_INDENTED.match(line) for line in text.split("\n")) else "brace"


def scan(text: str, style: str) -> list[Line]:
    """The lines with their depth of brackets; a quote that does not close on its line is an apostrophe."""
    rows = text.split("\n")
    lines = [Line(rows[0], 0, False)]
    depth, quote = 0, ""
    long_quotes = ('"""', "'''") if style == "indent" else ("`",)
    at = 0
    while found := _MARKS[style].search(text, at):
        mark, line, at = found.group(), lines[-1], found.end()
        if mark == "\n":
            if quote not in (*long_quotes, "/*"):
                quote = ""
            line.end = depth
            lines.append(Line(rows[len(lines)], depth, bool(quote)))
        elif quote:
            if mark == quote or (quote, mark) == ("/*", "*/"):
                quote = ""
        elif mark in ("#", "//"):
            quote = "//"
            # nothing counts before the end of the line
            stop = text.find("\n", at)
            at = stop if stop >= 0 else len(text)
        elif mark in ('"', "'"):
            stop = text.find("\n", found.end())
            rest = text[found.end(): stop if stop >= 0 else len(text)]
            # behind these a lifetime begins, not a string
            named = style == "brace" and mark == "'" and text[max(0, found.start() - 1): found.start()] in ("&", "<")
            quote = mark if mark in rest and not named else ""
        elif mark in long_quotes or mark == "/*":
            quote = mark
        elif mark in _OPEN:
            depth += 1
            line.opens |= mark == "{"
        elif mark in _CLOSE:
            depth = max(0, depth - 1)
        elif mark == ";":
            line.ends_statement |= depth == line.depth
    lines[-1].end = depth
    return lines


@dataclass
class Span:
    """Lines ``first`` up to but without ``last`` of one definition; ``owner`` is the place of the span around it, or -1."""

    kind: str
    name: str
    head: str
    owner: int
    first: int
    last: int
    indent: int


def _indented(lines: list[Line]) -> list[Span]:
    spans: list[Span] = []
    open_: list[int] = []
    last_full = 0
    for at, line in enumerate(lines):
        if line.starts and line.depth == 0 and not line.text.lstrip().startswith("#"):
            while open_ and line.indent <= spans[open_[-1]].indent:
                spans[open_.pop()].last = last_full + 1
            found = _INDENTED.match(line.text)
            if found:
                spans.append(Span(found["kind"], found["name"], f"{found['kind']} {found['name']}:", open_[-1] if open_ else -1, at, len(lines), line.indent))
                open_.append(len(spans) - 1)
        if line.text.strip() and not (line.starts and line.depth == 0 and line.text.lstrip().startswith("#")):
            last_full = at
    for place in open_:
        spans[place].last = last_full + 1
    return spans


def _braced(lines: list[Line]) -> list[Span]:
    spans: list[Span] = []
    #: (place of the span, depth outside it, whether its brace was seen)
    open_: list[list] = []
    for at, line in enumerate(lines):
        found = _BRACED.match(line.text) if line.starts else None
        if found and (not open_ or open_[-1][2]):
            head = line.text.split("{")[0].strip()
            spans.append(Span(found["kind"], found["name"] or "", head, open_[-1][0] if open_ else -1, at, len(lines), line.depth))
            open_.append([len(spans) - 1, line.depth, False])
        if open_:
            top = open_[-1]
            top[2] |= line.opens
            if not top[2] and line.ends_statement and line.end <= top[1]:
                spans[open_.pop()[0]].last = at + 1
        while open_ and open_[-1][2] and line.end <= open_[-1][1]:
            spans[open_.pop()[0]].last = at + 1
    return spans


def spans_of(text: str) -> tuple[str, list[Line], list[Span]]:
    style = style_of(text)
    lines = scan(text, style)
    return style, lines, _indented(lines) if style == "indent" else _braced(lines)


def _docstring(lines: list[Line], first: int, last: int) -> str:
    """The string that the block starts with, its margin taken off; empty where there is none."""
    for at in range(first, last):
        text = lines[at].text.strip()
        if not text or text.startswith("#"):
            continue
        found = re.match(r"[rRuU]?(\"\"\"|'''|\"|')", text)
        if not found:
            return ""
        quote = found.group(1)
        body = "\n".join(x.text for x in lines[at:last]).lstrip()[found.end():]
        end = body.find(quote)
        if end < 0 or (len(quote) == 1 and "\n" in body[:end]):
            return ""
        return inspect.cleandoc(body[:end]).strip()
    return ""


def chunks_of(text: str | None) -> Iterator[str]:
    """Docstring of the module, then each function and class of the top level, and methods under the head of their class."""
    if not text:
        return
    style, lines, spans = spans_of(text)
    said = False
    block = lambda s: "\n".join(x.text for x in lines[s.first: s.last]).strip()
    if style == "indent":
        doc = _docstring(lines, 0, len(lines))
        if doc:
            said = True
            yield doc
    for place, span in enumerate(spans):
        if span.owner >= 0:
            continue
        own = block(span)
        doc = _docstring(lines, span.first + 1, span.last) if style == "indent" and span.kind == "class" else ""
        whole = f'{span.head}\n"""{doc}"""' if doc else own
        if doc or len(own) > SHORT:
            said = True
            yield whole
        if style == "indent" and span.kind == "class":
            for method in spans[place + 1:]:
                if method.owner == place and method.kind == "def" and len(block(method)) > SHORT:
                    yield f"{span.head}\n{block(method)}"
    if not said:
        yield from (b.strip() for b in text.split("\n\n") if len(b.strip()) > SHORT)


@F.pandas_udf(ArrayType(StringType()))
def split_code(source: pd.Series) -> pd.Series:
    """Whole blocks of source code, see :func:`chunks_of`."""
    return source.map(lambda text: list(chunks_of(text)))


SPAN = StructType([
    StructField("kind", StringType()), StructField("name", StringType()), StructField("owner", StringType()),
    StructField("first_line", IntegerType()), StructField("last_line", IntegerType()),
])


@F.pandas_udf(ArrayType(SPAN))
def code_spans(source: pd.Series) -> pd.Series:
    """Every definition with its owner (null at the top level) and its lines, from 1."""

    def rows(text: str | None) -> list[dict]:
        spans = spans_of(text)[2] if text else []
        return [
            {"kind": s.kind, "name": s.name, "owner": spans[s.owner].name if s.owner >= 0 else None, "first_line": s.first + 1, "last_line": s.last}
            for s in spans
        ]

    return source.map(rows)
