"""Language identification by cross-parsing with suffix automata.

For each language a suffix automaton of labelled text holds all of its substrings.  A text is parsed
greedily into the longest phrases that the automaton knows; with n characters of training text a
phrase costs log2(n) bits, and the language with the fewest bits wins.  The automata are
transition tables, and a task steps through many pieces of texts at once.

Every letter and mark of the training text of a language is a symbol of its own there; a letter that the
language does not have is a phrase by itself.  White space is one symbol, digits and signs are another.

Training takes a bounded sample: of each language the first ``TRAIN_TEXTS`` different texts in the order of a
hash, ``TRAIN_CHARS`` characters in all; of a text longer than its share, ``SPREAD`` parts from its start
to its end.  Every character of every text is parsed; a phrase ends at
the border of a piece of ``PIECE`` characters, for all languages alike.

Defined results: a null text, one without a letter, and every text where nothing was learned are ``und`` with
score 0.  Ties go to the smaller language name.  Repeated rows get equal results.  An empty
table gives no rows.  Columns other than text are not looked at in a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import crc_remainder, free_name, table
from .registry import query

#: bound of the training sample per language
TRAIN_TEXTS, TRAIN_CHARS = 64, 48_000
#: parts of a long text in the sample
SPREAD = 6
#: entries of a transition table that is kept whole; characters of a piece; characters of a step
TABLE, PIECE, STEP_CHARS = 2 * TRAIN_CHARS * 64, 512, 1 << 21
UNKNOWN = "und"

# fixed values: symbols of digits and signs, of white space, of letters that were not learned; letters follow
SIGN, SPACE, FOREIGN, LETTERS = 0, 1, 2, 3
#: letters and marks lie below this code point
_PLANES = 0x40000


class Arcs:
    """Transitions (state, symbol) -> state: a whole table, or hashed where the alphabet makes that too large.

    The last state stands before a phrase and has no transitions.
    """

    def __init__(self, follow: list[dict[int, int]], width: int) -> None:
        self.width, self.start = width, len(follow)
        self.first = np.full(width, self.start, np.int32)
        for s, to in follow[0].items():
            self.first[s] = to
        self.whole = (len(follow) + 1) * width <= TABLE
        if self.whole:
            self.to = np.full((len(follow) + 1) * width, -1, np.int32)
            for state, arcs in enumerate(follow):
                for s, to in arcs.items():
                    self.to[state * width + s] = to
            return
        keys = np.array([state * width + s for state, arcs in enumerate(follow) for s in arcs], np.int64)
        to = np.array([x for arcs in follow for x in arcs.values()], np.int32)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.to[slot[won]] = to[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        if self.whole:
            return self.to[state * self.width + symbol]
        keys = state.astype(np.int64) * self.width + symbol
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.to[slot[hit]]
            on = (there >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


def automaton(symbols: list[int], width: int) -> Arcs:
    """The suffix automaton of these symbols."""
    follow, link, longest = [{}], [-1], [0]
    last = 0
    for s in symbols:
        new = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p, last = last, new
        while p >= 0 and s not in follow[p]:
            follow[p][s] = new
            p = link[p]
        if p < 0:
            continue
        q = follow[p][s]
        if longest[q] == longest[p] + 1:
            link[new] = q
            continue
        copy = len(follow)
        follow.append(dict(follow[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        link[q] = link[new] = copy
        while p >= 0 and follow[p].get(s) == q:
            follow[p][s] = copy
            p = link[p]
    return Arcs(follow, width)


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, str]:
    """The training text of each language."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    spark = labelled.sparkSession
    hashes = settle(rows.select("l", "h").distinct())
    chosen = []
    for (name,) in hashes.select("l").distinct().collect():  # languages, not rows
        some = hashes.where(F.col("l") == name).orderBy("h").limit(TRAIN_TEXTS).collect()
        chosen += [(name, r.h, TRAIN_CHARS // len(some)) for r in some]
    # written, so that Spark knows its size and need not shuffle texts to find these
    wanted = settle(spark.createDataFrame(chosen, "l string, h long, each int"))
    size, length = F.col("each") - SPREAD + 1, F.length("t")  # the parts are joined by a line end
    part = F.floor(size / SPREAD).cast("int")
    parts = [F.substr("t", (F.lit(1) + F.floor((length - part) * i / (SPREAD - 1))).cast("int"), part) for i in range(SPREAD)]
    cut = F.when(length <= F.col("each"), F.col("t")).otherwise(F.concat_ws("\n", *parts))
    found = rows.join(wanted, ["l", "h"]).groupBy("l", "h").agg(F.min(cut).alias("t")).collect()  # bounded by the sample
    texts: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.l, r.h)):
        texts.setdefault(r.l, []).append(r.t)
    joined = {name: "\n".join(some).lower() for name, some in texts.items()}
    return {name: t for name, t in joined.items() if any(map(str.isalpha, t))}


def _is_letter(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


def symbols_of(text: str, symbol: np.ndarray) -> np.ndarray:
    return symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, list[tuple[str, np.ndarray, Arcs, float]]]:
    """(symbol of each code point, [(language, its own symbol of each symbol, automaton, bits per phrase)])."""
    texts = sample(labelled, text, lang)
    letters = {c: i + LETTERS for i, c in enumerate(sorted({c for t in texts.values() for c in set(t) if _is_letter(c)}))}
    symbol = np.full(0x110000, SIGN, np.int32)
    for point in range(_PLANES):
        c = chr(point)
        if _is_letter(c):
            symbol[point] = letters.get(c, letters.get(c.lower()[0], FOREIGN))
    symbol[[0x20, *range(0x09, 0x0E)]] = SPACE
    models = []
    for name in sorted(texts):
        coded = symbols_of(texts[name], symbol)
        own = np.unique(coded[coded >= LETTERS])
        local = np.full(len(letters) + LETTERS, FOREIGN, np.uint16)  # a sample has fewer letters than this holds
        local[SIGN], local[SPACE] = SIGN, SPACE
        local[own] = np.arange(len(own)) + LETTERS
        models.append((name, local, automaton(local[coded].tolist(), len(own) + LETTERS), float(np.log2(len(coded) + 1))))
    return symbol, models


def phrases(pieces: np.ndarray, lengths: np.ndarray, arcs: Arcs) -> np.ndarray:
    """Phrases of each row of symbols; rows come longest first."""
    state = np.full(len(pieces), arcs.start, np.int32)
    out = np.zeros(len(pieces), np.int64)
    for i in range(pieces.shape[1]):
        live = int(np.searchsorted(-lengths, -i, "left"))
        if not live:
            break
        c = pieces[:live, i]
        nxt = arcs.step(state[:live], c)
        broken = np.flatnonzero(nxt < 0)
        # a phrase starts with this symbol; an unknown symbol is one by itself
        out[broken] += 1
        nxt[broken] = arcs.first[c[broken]]
        state[:live] = nxt
    return out


def identify(docs: DataFrame, model, text: Column) -> DataFrame:
    """``docs`` with lang_pred and score, with underscores before names that ``docs`` has; ``model`` is what ``learn`` gives, as a broadcast."""
    out = [free_name(docs, "lang_pred"), free_name(docs, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, models = model.value

        def parse(texts: list[str]) -> np.ndarray:
            bits = np.zeros((len(texts), len(models)))
            coded = [symbols_of(t, symbol) for t in texts]
            counts = np.array([-(-len(c) // PIECE) for c in coded], np.int64)
            total = int(counts.sum())
            owner = np.repeat(np.arange(len(texts)), counts)
            grid, lengths = np.zeros((total, PIECE), np.int32), np.zeros(total, np.int64)
            at = 0
            for c, n in zip(coded, counts, strict=True):
                grid[at: at + n].reshape(-1)[: len(c)] = c
                if n:
                    lengths[at: at + n] = PIECE
                    lengths[at + n - 1] = len(c) - (n - 1) * PIECE
                at += n
            order = np.argsort(-lengths, kind="stable")
            grid, lengths, owner = grid[order], lengths[order], owner[order]
            for j, (_, local, arcs, cost) in enumerate(models):
                bits[:, j] = np.bincount(owner, phrases(local[grid], lengths, arcs), len(texts)) * cost
            return bits

        for batch in batches:
            # the texts come last
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and models and any(map(str.isalpha, t))]
            while known:
                size, k = 0, 0
                while k < len(known) and (k == 0 or size + len(texts[known[k]]) <= STEP_CHARS):
                    size += len(texts[known[k]])
                    k += 1
                part, known = known[:k], known[k:]
                for i, row in zip(part, parse([texts[i] for i in part]), strict=True):
                    best = int(np.argmin(row))
                    rest = np.delete(row, best)
                    lang[i] = models[best][0]
                    score[i] = float(1.0 - row[best] / (row[best] + rest.min())) if len(rest) else 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score)], names=[*batch.schema.names[:-1], *out])

    from pyspark.sql import types as T

    shape = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    return docs.select("*", text.cast("string").alias(free_name(docs, "_text"))).mapInArrow(run, shape)


@query("op1_crossparse")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = spark.sparkContext.broadcast(learn(docs.where(crc_remainder("doc_id", 5) != 0)))  # bounded by the sample
    texts = docs.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return identify(texts, model, F.col("text")).select("doc_id", "held_out", "lang_pred", "score")
