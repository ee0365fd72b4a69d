"""Spans and chunks of source code."""

import ast
import inspect
import random

from lorestone.functions.code import chunks_of, scan, spans_of

PYTHON = '''"""Module
   text."""
import os

# def not_this(): a comment
@decorator
def first(a, b=(1,
        2)):
    """Doc of first, def inside(): no."""
    text = "class Fake: (["

    def inner():
        return 1
    return a  # ends ( here

class Empty:
    pass

class Holder(Base):
    \'\'\'Doc of holder.

      indented
    \'\'\'
    x = 1

    async def method(self):
        return f"{self.x} and some more text"

    class Nested:
        def deep(self): return 2
# trailing comment
value = 3
def last(): return "a function on one line that is long enough"
'''


def test_python_spans_agree_with_the_parser():
    _, _, spans = spans_of(PYTHON)
    tree = ast.parse(PYTHON)
    want = sorted((n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))
    assert sorted((s.name, s.first + 1, s.last) for s in spans) == want
    owners = {s.name: spans[s.owner].name if s.owner >= 0 else None for s in spans}
    assert owners == {"first": None, "inner": "first", "Empty": None, "Holder": None, "method": "Holder", "Nested": "Holder", "deep": "Nested", "last": None}


def test_spans_of_this_library_agree_with_the_parser():
    import lorestone.functions.code
    import lorestone.operators.metrics
    import lorestone.plans.growing
    import lorestone.streaming.jobs

    for module in (lorestone.functions.code, lorestone.operators.metrics, lorestone.plans.growing, lorestone.streaming.jobs):
        text = inspect.getsource(module)
        want = sorted((n.name, n.lineno, n.end_lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))
        assert sorted((s.name, s.first + 1, s.last) for s in spans_of(text)[2]) == want


def test_chunks_are_whole():
    got = list(chunks_of(PYTHON))
    assert got[0] == "Module\ntext."
    assert got[1].startswith("def first(a, b=(1,") and got[1].endswith("return a  # ends ( here")
    assert got[2] == 'class Holder:\n"""Doc of holder.\n\nindented"""'
    assert got[3] == 'class Holder:\nasync def method(self):\n        return f"{self.x} and some more text"'
    assert got[4].startswith("def last()") and len(got) == 5
    long = "def f():\n" + "    x = 1\n" * 5000
    assert list(chunks_of(long)) == [long.strip()]


RUST = """// fn not_this() {
use std::fmt; /* struct Nor { this */
pub struct Point<'a> {
    name: &'a str, // don't close {
}
struct Unit;
impl<'a> Point<'a> {
    pub fn len(&self) -> usize
    {
        if self.name == "}" { 0 } else { 1 }
    }
    fn brace(&self) -> char { '{' }
}
function main(a) { return `fn x() {
 }`; }
"""


def test_braced_spans():
    _, _, spans = spans_of(RUST)
    got = [(s.kind, s.name, spans[s.owner].name if s.owner >= 0 else None, s.first + 1, s.last) for s in spans]
    assert got == [("struct", "Point", None, 3, 5), ("struct", "Unit", None, 6, 6), ("impl", "Point", None, 7, 13), ("fn", "len", "Point", 8, 11),
                   ("fn", "brace", "Point", 12, 12), ("function", "main", None, 14, 15)]
    assert list(chunks_of(RUST))[1].startswith("impl<'a> Point<'a> {") and list(chunks_of(RUST))[1].endswith("}")


def test_other_texts_fall_back_to_blocks():
    assert list(chunks_of("short\n\n" + "a paragraph that is long enough to be kept\n\n")) == ["a paragraph that is long enough to be kept"]
    assert list(chunks_of(None)) == list(chunks_of("")) == []
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["def f(", "class A:", "{", "}", "'", '"', "\n", "    ", "(", ")", "fn x", "//", "#", '"""', ";", "\\"]) for _ in range(30))
        spans = spans_of(text)[2]
        assert all(0 <= s.first < s.last <= text.count("\n") + 1 for s in spans)
        assert len(scan(text, "indent")) == text.count("\n") + 1
        list(chunks_of(text))


def test_marks_in_a_comment_are_passed_over_to_the_end_of_the_line(monkeypatch):
    from lorestone.functions import code as C

    text = "def a(x):\n" + "    # not (a [b {c \"d 'e \\\\ here\n" * 50 + "    return '#(' + x  # (\ndef b(y):\n    return y\n# ("
    seen = []

    class Marks:
        def __init__(self, marks):
            self.marks = marks

        def search(self, *args):
            seen.append(args)
            return self.marks.search(*args)

        def finditer(self, *args):
            for found in self.marks.finditer(*args):
                seen.append(found)
                yield found

    monkeypatch.setattr(C, "_MARKS", {k: Marks(v) for k, v in C._MARKS.items()})
    assert [(s.name, s.first, s.last) for s in C.spans_of(text)[2]] == [("a", 0, 52), ("b", 52, 54)]
    # before, every mark of a comment was looked at
    assert len(seen) < 150
