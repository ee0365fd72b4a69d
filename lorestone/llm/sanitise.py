"""Sanitising personal data: patterns first, then terms that reveal the protected values.

The patterns find protected values.  Words of the texts that hold a value are terms that may
reveal it, wherever they stand in the text.  The corpus tells how strongly: of the different texts that hold
the term, the share that holds that very value, P(value | term), and the information it gives,
log2(P(value | term) / P(value)); all of these texts are counted exactly.  A term above both thresholds and with
the value in enough different texts is removed wherever it stands.

Counts cover all documents.  The bounds that keep the pairs few follow from the thresholds: a share is at
most 1, so a value in more than one of 2**BITS texts has no terms; and a term must have SHARE already
among the texts that hold some value, before its other texts are counted.  The filters that tasks hold are bit tables of fixed size, and
exact joins on 64-bit hashes follow.

Defined results: null text is empty and has no spans.  Repeated rows get the same spans, and equal texts
count once.  Texts of any length are searched whole; all patterns run in linear time.  An empty
table gives no rows.  Columns other than id and text stay out of the search and, in ``sanitised``, stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import free_name, table, utf8, word_bounds, word_hashes
from .registry import query

KINDS = ("email", "ip", "card", "phone", "term")
#: different texts that must hold both a term and the value
SUPPORT = 4
#: least P(value | term) and least information in bits
SHARE, BITS = 0.8, 6.0
#: size of the bit tables; words of a step
FILTER_BITS, STEP_WORDS = 24, 1 << 20

# fixed values: the base patterns; lookbehind and possessive runs only keep them linear
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kinds and places."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, places in code points."""
    data, offsets = utf8(pa.array([text]))
    part = data[offsets[0]: offsets[1]]
    starts, ends, _ = word_bounds(part, offsets - offsets[0])
    points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    return word_hashes(part, starts, ends), points[starts], points[ends]


def _outside(spans: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    free = np.ones(len(starts), bool)
    for _, a, b in spans:
        free[np.searchsorted(ends, a, "right"): np.searchsorted(starts, b, "left")] = False
    return free


def _value(kind: int, raw: str) -> int:
    """A 62-bit hash of a protected value."""
    import zlib

    data = raw.lower().encode()
    return (zlib.crc32(data) << 31) ^ zlib.adler32(data) ^ kind


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, digest) once for each value of a text, and (null, digest) for each text."""
    for batch in batches:
        values, digests = [], []
        for text, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {_value(kind, text[a:b]) for kind, a, b in base_spans(text or "")}
            values += [None, *found]
            digests += [digest] * (len(found) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(digests, pa.int64())], names=["value", "digest"])


def _bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """True for the buckets of the hashes; of fixed size."""
    found = hashes.select(F.shiftrightunsigned(column, 64 - FILTER_BITS).alias("b")).distinct().toArrow()  # at most 2**FILTER_BITS rows
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[found.column(0).to_numpy()] = True
    return np.packbits(bits)


def _hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bucket = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1


def _with_letters(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(points, return_inverse=True)
    before = np.concatenate([[0], np.cumsum(np.array([chr(k).isalpha() for k in kinds.tolist()], bool)[at])])
    return before[ends] > before[starts]


def _terms(text: str, bits: np.ndarray | None) -> np.ndarray:
    """Different hashes of the words with a letter outside of all values; with ``bits`` only those found there."""
    if not text:
        return np.zeros(0, np.uint64)
    hashes, starts, ends = _words(text)
    keep = _with_letters(text, starts, ends) if bits is None else _hit(bits, hashes)
    hashes, starts, ends = hashes[keep], starts[keep], ends[keep]
    return np.unique(hashes[_outside(base_spans(text), starts, ends)]) if len(hashes) else hashes


def _holding(texts: DataFrame, inside, terms, repeated) -> DataFrame:
    """(term, digest, n): n different texts hold the term.

    Only texts in ``inside`` and terms in ``terms`` count, all where these are None.  Texts that are not in
    ``repeated`` are added up in the task and have a null digest; of others, and where it is None, each
    has a row with its digest, and copies in other tasks have the same row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, wanted, again = (x and x.value for x in (inside, terms, repeated))

        def rows(once: list[np.ndarray], each: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *once]), return_counts=True)
            term = np.concatenate([found, *[x for _, x in each]]).view(np.int64)
            digest = np.concatenate([np.zeros(len(found), np.int64), *[np.full(len(x), d) for d, x in each]])
            n = np.ones(len(term), np.int64)
            n[: len(found)] = counts
            return pa.RecordBatch.from_arrays([pa.array(term), pa.array(digest, mask=np.arange(len(term)) < len(found)), pa.array(n)], names=["term", "digest", "n"])

        for batch in batches:
            digests = batch.column(1).to_numpy()
            hashed = digests.view(np.uint64)
            live = np.ones(len(digests), bool) if within is None else _hit(within, hashed)
            apart = np.ones(len(digests), bool) if again is None else _hit(again, hashed)
            once, each, size, met = [], [], 0, set()
            for i in np.flatnonzero(live).tolist():
                digest = int(digests[i])
                if apart[i]:
                    if digest in met:
                        continue
                    met.add(digest)
                found = _terms(batch.column(0)[i].as_py(), wanted)
                if apart[i]:
                    each.append((digest, found))
                else:
                    once.append(found)
                size += len(found)
                if size > STEP_WORDS:
                    yield rows(once, each)
                    once, each, size = [], [], 0
            yield rows(once, each)

    return texts.mapInArrow(run, "term long, digest long, n long")


def _texts_of(held: DataFrame) -> DataFrame:
    """(term, texts) from ``_holding``."""
    one = held.groupBy("term", "digest").agg(F.sum("n").alias("n"))
    return one.groupBy("term").agg(F.sum(F.when(F.col("digest").isNull(), F.col("n")).otherwise(1)).alias("texts"))


def revealing_terms(docs: DataFrame) -> DataFrame:
    """(term): hashes of the words that reveal a protected value, from (text, digest) of all documents."""
    spark = docs.sparkSession
    shared = lambda df, column: spark.sparkContext.broadcast(_bit_table(df, column))
    texts = docs.select("text", "digest")
    seen = settle(texts.mapInArrow(_seen, "value long, digest long").groupBy("value", "digest").agg(F.count("*").alias("copies")))
    total = seen.where("value is null").count()
    values = settle(
        seen.where("value is not null").groupBy("value").agg(F.count("*").alias("holding"))
        .where((F.col("holding") >= SUPPORT) & (F.log2(F.lit(total) / F.col("holding")) >= BITS))
    )
    most = values.agg(F.max("holding")).first()[0]
    if most is None:
        return values.select(F.col("value").alias("term"))  # no rows
    holders = settle(seen.where("value is not null").join(values, "value").select("value", "digest", "holding"))
    inside, repeated = shared(holders, "digest"), shared(seen.where("value is null and copies > 1"), "digest")
    # a term's texts are at least those beside a value, and SHARE of them hold one value; so this holds for the latter too
    fits = (F.col("texts") >= SUPPORT) & (F.lit(most) / F.col("texts") >= SHARE)
    near = settle(_texts_of(_holding(texts, inside, None, repeated)).where(fits))
    held = _holding(texts, inside, shared(near, "term"), None).select("term", "digest").distinct()
    pairs = settle(
        held.join(near, "term").join(holders, "digest").where(F.col("holding") / F.col("texts") >= SHARE)
        .groupBy("value", "term").agg(F.count("*").alias("together"), F.first("texts").alias("near"), F.first("holding").alias("holding"))
        .where((F.col("together") >= SUPPORT) & (F.col("together") / F.col("near") >= SHARE))
    )
    df = _texts_of(_holding(texts, None, shared(pairs, "term"), repeated))
    share = F.col("together") / F.col("texts")
    return pairs.join(df, "term").where(
        (share >= SHARE) & (F.log2(share * total / F.col("holding")) >= BITS)
    ).select("term").distinct()


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, spans) of every document; spans are (kind, start, end) in that order."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("digest", F.xxhash64("text"))
    flagged = settle(revealing_terms(plain))
    bits = spark.sparkContext.broadcast(_bit_table(flagged, "term"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        near = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        table_ = bits.value
        for batch in batches:
            base, hits = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text)
                hashes, starts, ends = _words(text)
                at = np.flatnonzero(_hit(table_, hashes) & _outside(own, starts, ends))
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                hits.append([{"term": int(hashes[i : i + 1].view(np.int64)[0]), "start": int(starts[i]), "end": int(ends[i])} for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(base, kind), pa.array(hits, near)], names=["doc_id", "digest", "base", "hits"])

    shape = "doc_id long, digest long, base array<struct<kind:int,start:long,end:long>>, hits array<struct<term:long,start:long,end:long>>"
    found = settle(plain.mapInArrow(find, shape))
    exact = (
        found.where("size(hits) > 0").select("digest", F.explode("hits").alias("h")).select("digest", "h.*").distinct()
        .join(flagged, "term").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("more"))
    )
    return found.join(exact, "digest", "left").select(
        "doc_id", "digest", F.sort_array("base").alias("base"),
        F.sort_array(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<kind:int,start:long,end:long>>)")))).alias("spans"),
    )


@F.udf(T.StringType())
def _masked(text, found):
    if not found:
        return text
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at: s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; a null text stays null."""
    digest, own = free_name(docs, "_digest"), free_name(docs, "_spans")
    found = spans(docs).where("size(spans) > 0").select(F.col("digest").alias(digest), F.col("spans").alias(own)).dropDuplicates([digest])
    joined = docs.join(found, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(digest), "left")
    new = F.when(F.col(own).isNull(), F.col("text")).otherwise(_masked("text", F.when(F.col(own).isNotNull(), F.col(own))))
    return joined.select(*[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _digest(found) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


@query("op5_sanitise")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = spans(table(spark, folder, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
    )
