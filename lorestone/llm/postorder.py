"""Merkle manifest of a dataset, kept as an append log in postorder.

Every row is a leaf; the leaves of a source, in the order of their ids, are hashed in runs of ``FAN`` up to one
subroot, and the subroots of all sources in the same way up to the root.  The nodes of a source form one log
in the order in which an appending writer completes them: a node comes right after the last of its children.
The place of a node in that log follows from its level, its index and the number of leaves alone
(``position``), so builders work on aligned ranges of leaves without knowing of each other, and whoever
needs a proof computes the places of the siblings and joins on them.

A builder owns ``FAN ** BUILT`` leaves and writes their part of the log as one run of digests; the nodes above
are built in rounds of the same kind, each over a table smaller by that factor, and are log rows by themselves.
No task holds more than one such range.

Defined results: a null field hashes as ``-``, differently from an empty one.  Null sources are one source, the
first; null ids come first in their source.  Rows with equal ids are ordered by their digests, so
repeated rows are leaves of their own.  Texts of any length are hashed whole.  An empty table gives no rows.
Columns beyond the five fields are not looked at and may have any names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .common import table
from .registry import query

#: children of a node
FAN = 16
#: levels that one builder raises: it owns FAN ** BUILT nodes of a level
BUILT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: one id in this many is tampered with in the query
TAMPERED = 5


def hashed(parts: bytes) -> bytes:
    return hashlib.sha256(parts).digest()


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the log of a tree with that many leaves.

    When the node is complete, the nodes before it are those of its level and below that end with or before
    its last leaf, and those above that ended before that leaf.
    """
    last = min((index + 1) * FAN ** level, leaves) - 1
    below = sum(-(-(last + 1) // FAN ** j) for j in range(level + 1))
    above, span = 0, FAN ** (level + 1)
    while span <= last:
        above, span = above + last // span, span * FAN
    return below - 1 + above


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while FAN ** levels < leaves:
        levels += 1
    return levels


def appended(nodes: list[bytes], levels: int) -> list[tuple[int, bytes]]:
    """(level, digest) of the nodes of an aligned range in the order of their completion."""
    log: list[tuple[int, bytes]] = []
    open_: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def complete(level: int, digest: bytes) -> None:
        log.append((level, digest))
        if level < levels:
            open_[level].append(digest)
            if len(open_[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        complete(level + 1, hashed(b"".join(run).hex().encode()))

    for digest in nodes:
        complete(0, digest)
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """(doc_id, source, grp, leaf, forged): digests of the rows, and of the tampered text where ``tampered`` holds.

    ``fields`` name id, source, language, length and text.  ``grp`` orders the sources, null first.
    """
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def digest(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[part(F.col(c)) for c in fields[:4]], part(text)), 256))

    text = F.col(fields[4]).cast("string")
    forged = digest(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return docs.select(
        F.col(fields[0]).cast("long").alias("doc_id"), F.col(fields[1]).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("1"), F.col(fields[1]).cast("string")), F.lit("0")).alias("grp"), digest(text).alias("leaf"),
        F.when(F.lit(False) if tampered is None else tampered, forged).alias("forged"),
    )


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The settled rows with ``rank`` (from 0 within ``grp``) and ``n``, the rows of the group.

    Rows are sorted into ranges; a rank is the place inside the range plus the rows of the group in earlier
    ranges, of which there is one count per range and group.
    """
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            local = []
            for grp in batch.column("grp").to_pylist():
                last, at = grp, at + 1 if grp == last else 0
                local.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*names, "local"])

    sorted_ = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = settle(sorted_.mapInArrow(number, f"{schema}, local long").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("grp", "part").agg(F.count("*").alias("here"))
    before = W.partitionBy("grp").orderBy("part")
    counts = counts.select(
        "grp", "part", (F.sum("here").over(before) - F.col("here")).alias("earlier"), F.sum("here").over(W.partitionBy("grp")).alias("n"),
    )
    return dealt.join(counts, ["grp", "part"]).select(*names, (F.col("earlier") + F.col("local")).alias("rank"), "n")


def _ranges(batches: Iterator[pa.RecordBatch], built: int) -> Iterator[tuple[str, int, list[dict]]]:
    """(grp, range, rows) from rows sorted by (grp, rank)."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["grp"], row["rank"] // FAN ** built)
            if here != key:
                if rows:
                    yield *key, rows
                key, rows = here, []
            rows.append(row)
    if rows:
        yield *key, rows


def _aligned(nodes: DataFrame, built: int) -> DataFrame:
    return nodes.withColumn("range", F.expr(f"rank div {FAN ** built}")).repartition("grp", "range").sortWithinPartitions("grp", "rank").drop("range")


def _raised(count: int, built: int) -> int:
    """Levels that a range is raised where its group has ``count`` nodes on the range's lowest level."""
    return min(built, height(count))


def segments(rows: DataFrame, built: int = BUILT) -> DataFrame:
    """One row per range of leaves: its run of the log, its top, and what a proof needs of its rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, index, found in _ranges(batches, built):
            n = found[0]["n"]
            log = appended([r["leaf"] for r in found], _raised(n, built))
            yield pa.RecordBatch.from_pylist([{
                "grp": grp, "source": found[0]["source"], "range": index, "n": n, "at": position(0, index * FAN ** built, n),
                "log": b"".join(d for _, d in log), "top": log[-1][1], "ids": [r["doc_id"] for r in found], "forged": [r["forged"] for r in found],
            }], schema)

    schema = pa.schema([
        ("grp", pa.string()), ("source", pa.string()), ("range", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("log", pa.binary()),
        ("top", pa.binary()), ("ids", pa.list_(pa.int64())), ("forged", pa.list_(pa.binary())),
    ])
    return _aligned(rows, built).mapInArrow(
        build, "grp string, source string, range long, n long, at long, log binary, top binary, ids array<bigint>, forged array<binary>"
    )


LOG = "grp string, level int, rank long, n long, at long, digest binary"


def raise_nodes(nodes: DataFrame, level: int, built: int = BUILT) -> tuple[DataFrame, DataFrame]:
    """(log rows, tops) of trees over (grp, rank, n, digest), the nodes of one level; n counts leaves."""
    log: DataFrame | None = None
    while True:
        base = level

        def build(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for grp, index, found in _ranges(batches, built):
                n = found[0]["n"]
                up = _raised(-(-n // FAN ** base), built)
                at = [index * FAN ** (built - j) for j in range(up + 1)]
                out = []
                for j, digest in appended([r["digest"] for r in found], up):
                    # a top with further nodes above it is written by the next round
                    top = min(base + j, height(n))
                    place = position(top, at[j], n) if j < built or top == height(n) else None
                    out.append({"grp": grp, "level": top, "rank": at[j], "n": n, "at": place, "digest": digest})
                    at[j] += 1
                yield pa.RecordBatch.from_pylist(out, schema)

        schema = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("rank", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("digest", pa.binary())])
        raised = settle(_aligned(nodes.select("grp", "rank", "n", "digest"), built).mapInArrow(build, LOG))
        rows = raised.where("at is not null")
        log = rows if log is None else log.unionByName(rows)
        level += built
        nodes = raised.where("at is null")
        if nodes.isEmpty():
            break
    fan = FAN.bit_length() - 1
    tops = log.where(f"n <= shiftleft(1L, {fan} * level) and (level = 0 or n > shiftleft(1L, {fan} * (level - 1)))")
    return log, tops.select("grp", "n", "digest")


def siblings(members: DataFrame, log: DataFrame, level: int) -> DataFrame:
    """(grp, rank, path): for nodes (grp, rank, n) of a level, (level, index, digest) of all siblings up to the top.

    The places of the siblings are computed, not looked for.
    """

    def addresses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, index = row["n"], row["rank"]
                for up in range(level, height(n)):
                    first, count = index - index % FAN, -(-n // FAN ** up)
                    out += [
                        {"grp": row["grp"], "rank": row["rank"], "level": up, "index": i, "at": position(up, i, n)}
                        for i in range(first, min(first + FAN, count)) if i != index
                    ]
                    index //= FAN
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("grp", pa.string()), ("rank", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("at", pa.int64())])
    wanted = members.select("grp", "rank", "n").mapInArrow(addresses, "grp string, rank long, level int, index long, at long")
    found = wanted.join(log.select("grp", "at", "digest"), ["grp", "at"])
    # at most FAN - 1 siblings on each of the few levels of a tree
    return found.groupBy("grp", "rank").agg(F.sort_array(F.collect_list(F.struct("level", "index", "digest"))).alias("path"))


def _runs(path: list[dict] | None, index: int, low: int, high: int) -> list[tuple[str, str]]:
    """Hex of the siblings before and after the node ``index`` of level ``low``, for each level below ``high``."""
    out = []
    for level in range(low, high):
        here = [s for s in path or [] if s["level"] == level]
        out.append(("".join(s["digest"].hex() for s in here if s["index"] < index), "".join(s["digest"].hex() for s in here if s["index"] > index)))
        index //= FAN
    return out


RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, built: int = BUILT) -> DataFrame:
    """Proof and check of every row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A proof holds the siblings from the leaf to the root; ``folded_root`` folds them with the leaf, or with that
    of the tampered row where ``tampered`` holds, and ``verified`` says whether that gives the root.
    """
    rows = ranked(settle(leaves(docs, fields, tampered)), ["doc_id", "leaf"])
    parts = settle(segments(rows, built))
    log, subroots = raise_nodes(parts.select("grp", F.col("range").alias("rank"), "n", F.col("top").alias("digest")), built, built)
    subroots = settle(subroots)
    sources = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"])
    sources = settle(sources)
    above, root = raise_nodes(sources, 0, built)
    top = root.select("digest").first()
    if top is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    end = top["digest"].hex()
    last = siblings(sources, above, 0).select("rank", F.col("path").alias("last"))
    owners = sources.join(last, "rank", "left").select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), F.col("rank").alias("place"), F.col("n").alias("sources"), "last")
    paths = siblings(parts.select("grp", F.col("range").alias("rank"), "n"), log, built).withColumnRenamed("rank", "range")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(proofs(part, end, built), schema)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
        ("folded_root", pa.string()), ("verified", pa.bool_()),
    ])
    joined = parts.select("grp", "range", "n", "at", "log", "ids", "forged").join(paths, ["grp", "range"], "left").join(owners, "grp")
    return joined.mapInArrow(extract, RESULT)


def proofs(part: dict, root: str, built: int) -> list[dict]:
    """The result rows of one range of leaves."""
    n, index, at, log = part["n"], part["range"], part["at"], part["log"]
    first, size = index * FAN ** built, len(part["ids"])
    inside = _raised(n, built)

    def node(level: int, i: int) -> str:
        place = position(level, i, n) - at
        return log[32 * place: 32 * place + 32].hex()

    levels = [[node(level, (first // FAN ** level) + i) for i in range(-(-size // FAN ** level))] for level in range(inside)]
    upper = _runs(part["path"], index, built, height(n)) + _runs(part["last"], part["place"], 0, height(part["sources"]))
    tail = "".join(a + b for a, b in upper)
    leaf_of = levels[0] if inside else [log[:32].hex()]
    subroot = part["subroot"].hex()
    out = []
    for i in range(size):
        around = []
        for level in range(inside):
            own = i // FAN ** level
            low = own - own % FAN
            around.append(("".join(levels[level][low:own]), "".join(levels[level][own + 1: low + FAN])))
        forged = part["forged"][i]
        folded = leaf_of[i] if forged is None else forged.hex()
        for before, after in (*around, *upper):
            folded = hashlib.sha256((before + folded + after).encode()).hexdigest()
        out.append({
            "doc_id": part["ids"][i], "leaf": leaf_of[i], "subroot": subroot, "root": root,
            "proof_sha256": hashlib.sha256(("".join(a + b for a, b in around) + tail).encode()).hexdigest(),
            "folded_root": folded, "verified": folded == root,
        })
    return out


def _sql(levels: int = 8) -> str:
    """The trees level by level, each with at most FAN ** levels leaves."""
    def field(value: str) -> str:
        return f"coalesce(octet_length(encode({value}))::varchar || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(f"{c}::varchar") for c in FIELDS[:4]) + f" || {field(text)})"

    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    # crc32 of the digits: after each byte eight steps, marked -1
    sql = f"""with e as (select *, xor(list_reduce(
    flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: [ascii(substr(doc_id::varchar, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end, 4294967295::bigint), 4294967295) as crc from documents),
c as (select doc_id, source, lang, n_chars, text, coalesce(crc % {TAMPERED} = 0, false) as hit from e),
d as (select doc_id, coalesce('1' || source, '0') as grp, {leaf('text')} as leaf, case when hit then {leaf(f"translate(text, '{upper}', '{lower}')")} end as forged from c),
r as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i from d),
a0 as (select grp, i, leaf as h from r)"""
    # a tree that has one node left stays as it is
    for kind, start in (("a", "grp"), ("b", "grp")):
        for k in range(levels):
            sql += f""",
{kind}{k}m as (select *, count(*) over (partition by {start}) as n from {kind}{k}),
{kind}{k + 1} as (select grp, case when n = 1 then i else i // {FAN} end as i, case when max(n) = 1 then min(h) else sha256(string_agg(h, '' order by i)) end as h
  from (select grp, i, h, n from {kind}{k}m) group by grp, n, case when n = 1 then i else i // {FAN} end)"""
        if kind == "a":
            sql += f""",
s as (select grp as of, row_number() over (order by grp) - 1 as i, h from a{levels}),
b0 as (select '' as grp, i, h from s)"""
    rows, own, place = "select r.doc_id, r.grp, r.i, r.leaf, '' as proof, coalesce(r.forged, r.leaf) as f, s.i as p, s.h as subroot from r join s on s.of = r.grp", "grp", "i"
    names = [(f"a{k}m", "grp", "i") for k in range(levels)] + [(f"b{k}m", "''", "p") for k in range(levels)]
    sql += f",\nq0 as (select *, row_number() over () as uid from ({rows}))"
    for step, (nodes, own, place) in enumerate(names):
        k = step % levels
        sql += f""",
q{step + 1} as (select any_value(q.doc_id) as doc_id, any_value(q.grp) as grp, any_value(q.i) as i, any_value(q.leaf) as leaf,
  any_value(q.proof) || case when max(m.n) = 1 then '' else coalesce(string_agg(m.h, '' order by m.i) filter (where m.i <> q.{place} // {FAN ** k}), '') end as proof,
  case when max(m.n) = 1 then any_value(q.f) else sha256(string_agg(case when m.i = q.{place} // {FAN ** k} then q.f else m.h end, '' order by m.i)) end as f,
  any_value(q.p) as p, any_value(q.subroot) as subroot, q.uid
  from q{step} q join {nodes} m on m.grp = {'q.grp' if own == 'grp' else own} and m.i // {FAN} = (q.{place} // {FAN ** k}) // {FAN} group by q.uid)"""
    return sql + f"""
select doc_id, leaf, subroot, b{levels}.h as root, sha256(proof) as proof_sha256, f as folded_root, f = b{levels}.h as verified from q{2 * levels}, b{levels}"""


@query("op13_postorder", _sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return manifest(table(spark, folder, "documents"), tampered=tampered)
