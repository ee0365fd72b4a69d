"""Token counts by a two-tier lookup of pre-token lengths, inside the tasks that read the texts.

A tokenizer cuts a text into pre-tokens and encodes each by itself, so the tokens of a text are the sum of
the lengths of its pre-tokens.  The first tier is a compact table of the lengths of the most frequent
ones, broadcast once; what it misses is encoded by the library and kept in a bounded cache of the worker.
No pre-token is shuffled: finding the frequent ones, each task keeps at most ``COUNTED`` counts and
sends its ``SENT`` highest.  That choice only decides which tier answers, never the result.

Pre-tokens are found with the tokenizer's own pattern where every character of the text is known to be treated alike by
the pattern and by the library (each character is tried once per worker) and normalising changes no more than case.
Other texts are cut by the library itself, and those that hold an added token are encoded by it as a whole.

Defined results: a null text is empty and has no bytes and no tokens.  Repeated rows and repeated or
null ids are counted row by row.  Texts of any length are counted whole.  An empty table gives no rows.
Columns beyond id and text are not looked at and may have any names.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

#: pre-tokens in the broadcast table, each of at most LONGEST characters: some megabytes at any size of the corpus
FREQUENT = 1 << 16
LONGEST = 48
#: counts that a task keeps, and those that it sends
COUNTED = 1 << 17
SENT = 1 << 13
#: lengths that a worker's cache holds before it starts anew
CACHED = 1 << 18

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PreTokens:
    """Cuts texts into pre-tokens and measures these, as the library with this vocabulary (.json) does."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        pattern = self._pattern(spec)
        self.find = regex.compile(pattern).findall if pattern else None
        self.same: set[str] = set()
        self.other: set[str] = set()

    @staticmethod
    def _pattern(spec: dict) -> str | None:
        """The pattern of pre-tokens, for lower-casing tokenizers that drop what lies between them."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return None
        cut, bytes_ = steps
        if cut["behavior"] != "Removed" or not cut["invert"] or bytes_["add_prefix_space"] or bytes_["use_regex"]:
            return None
        return cut["pattern"].get("Regex")

    def by_library(self, text: str) -> list[str]:
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        if self.library.pre_tokenizer is None:
            return [text] if text else []
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def plain(self, text: str) -> bool:
        """Whether the pattern finds what the library finds."""
        if self.find is None:
            return False
        chars = set(text)
        for c in chars - self.same - self.other:
            # beside and between letters, digits, marks and spaces
            probe = f"a{c}a{c} {c}1{c}!{c}'s{c}{c} b{c}"
            (self.same if self.find(probe.lower()) == self.by_library(probe) else self.other).add(c)
        return chars <= self.same and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def cut(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where the text holds an added token."""
        low = text.lower()
        if any(t in text or t in low for t in self.added):
            return None
        return self.find(low) if self.plain(text) else self.by_library(text)

    def length(self, piece: str) -> int:
        """Tokens of one pre-token."""
        cut = self.library.pre_tokenizer
        mapped = cut.pre_tokenize_str(piece) if cut else [(piece, None)]
        return sum(len(self.library.model.tokenize(p)) for p, _ in mapped)

    def encoded(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def pretokens(vocabulary: str) -> PreTokens:
    return PreTokens(vocabulary)


class Lengths(dict):
    """The frequent pre-tokens; a miss is answered from the worker's cache, or encoded."""

    def __init__(self, frequent: dict[str, int], cut: PreTokens) -> None:
        super().__init__(frequent)
        self.cut = cut
        self.cache: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.cut.length(piece)
            if len(piece) <= LONGEST:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def total(self, text: str) -> int:
        pieces = self.cut.cut(text)
        return self.cut.encoded(text) if pieces is None else sum(map(self.__getitem__, pieces))


def frequent(texts: DataFrame, vocabulary: str, most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all texts, at most ``most``."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = pretokens(vocabulary), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(cut.cut(text.as_py() or "") or ())
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [(p, n) for p, n in seen.most_common(SENT) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pretokens(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cut.length(p) for p in batch.column(0).to_pylist()], pa.int32())], names=["piece", "length"])

    sums = texts.mapInArrow(heavy, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    chosen = sums.orderBy(F.desc("n"), "piece").limit(most).select("piece").mapInArrow(measure, "piece string, length int").toArrow()
    return dict(zip(chosen.column(0).to_pylist(), chosen.column(1).to_pylist(), strict=True))


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int, id_column: str = "doc_id", text_column: str = "text", most: int = FREQUENT
) -> DataFrame:
    """Bytes and tokens of every text: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent(texts.select("text"), vocabulary, most) if most else {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(shared.value, pretokens(vocabulary))
        for batch in batches:
            size, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                size.append(len(text) if text.isascii() else len(text.encode()))
                tokens.append(lengths.total(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts.mapInArrow(count, RESULT)


@query("op12_pretokens")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
