"""Divergence of sources: how far the term frequencies of the sources of a language lie apart.

One pass of ``bytes.translate`` over a text lowers A-Z and blanks every ASCII character that is no letter,
``bytes.split`` gives the terms, and a Counter per document their frequencies.  A task adds these up per language, source
and term, so what is shuffled is one row per task and different term, however hot a source or a term
is.  Terms in too few documents of their language go.

Everything after is sparse: a source has rows only for the terms that it holds.  For pairs of sources the terms
of a language are dealt to blocks of about ``TERMS``, and the sources to blocks of ``SOURCES``; a task holds one block
of terms for two blocks of sources.  Terms that neither block of sources holds are alike for all of them and are added as a
product.

All figures are integers; frequencies are scaled to ``SCALE`` with add-two smoothing.

Defined results: null language, source and text are read as ''.  A document without terms still makes
its group occur.  Repeated rows count again.  Texts of any length are counted whole.  Ties are ordered by the item's UTF-8
bytes.  An empty table gives no rows, a language without kept terms pairs of value 0.  Further columns are not looked at.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scale import top_per_key
from ..session import settle
from .common import table
from .registry import query

#: documents of a language that a term must stand in
LEAST = 10
SCALE = 1_000_000_000
#: terms that a group shows by themselves
SHOWN = 10
#: different (language, source, term) that a task adds up before it sends them
HELD = 300_000
#: terms and sources of a block
TERMS, SOURCES = 4096, 256

_LETTERS = string.ascii_letters.encode()
#: A-Z to a-z, other ASCII characters than letters to spaces, bytes above as they are
TRANSLATED = bytes(b | 32 if b in _LETTERS else b if b >= 0x80 else 0x20 for b in range(256))
_DOCUMENT = 1 << 40


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) per task, from (lang, source, text) without nulls."""

    def send(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            packed = np.fromiter(terms.values(), np.int64, len(terms))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                 pa.array(packed % _DOCUMENT), pa.array(packed // _DOCUMENT)], names=["lang", "source", "term", "n", "docs"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                terms = held.setdefault((lang, source), {})
                size -= len(terms)
                for term, n in Counter(text.as_py().translate(TRANSLATED).split()).items():
                    # occurrences below, documents above the border
                    terms[term] = terms.get(term, 0) + n + _DOCUMENT
                size += len(terms)
                if size >= HELD:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    return docs.mapInArrow(add, "lang string, source string, term string, n long, docs long")


def kept_terms(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, lang_n, head): terms in enough documents; ``head`` is 1 on one row of each term."""
    cells = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    return cells.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).cast("int").alias("head"),
    ).where(F.col("lang_docs") >= least).drop("lang_docs")


def scaled(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); the product may pass 64 bits."""
    return (F.lit(1) + F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * terms).cast("decimal(20,0)"))).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(cells: DataFrame) -> DataFrame:
    """(lang, low, high, f, terms) from (lang, terms_at, no, sources, term, p, p0), summed over the blocks.

    A cell is a term of the source numbered ``no`` of ``sources``; a row without term tells the ``p0`` of a source, which
    it has for every term that it does not hold.  ``terms`` counts the terms of the two blocks of sources.
    """
    blocks = cells.withColumn("block", F.expr(f"(no - 1) div {SOURCES}"))
    paired = blocks.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(sources - 1) div {SOURCES}"))))
    paired = paired.select("lang", "terms_at", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "no", "term", "p", "p0")
    # dealt by all four, or a language would be one task where an earlier step dealt by it
    paired = paired.repartition("lang", "terms_at", "a", "b")

    def block(key: tuple, part: pa.Table) -> pa.Table:
        a, b = key[2].as_py(), key[3].as_py()
        no = part.column("no").to_numpy()
        numbers, row = np.unique(no, return_inverse=True)
        coded = part.column("term").combine_chunks().dictionary_encode()
        width = len(coded.dictionary)
        has = ~np.asarray(coded.indices.is_null())
        base = np.empty(len(numbers), np.int64)
        base[row] = part.column("p0").to_numpy()
        grid = np.repeat(base[:, None], width, axis=1)
        grid[row[has], coded.indices.drop_null().to_numpy()] = part.column("p").to_numpy()[has]
        of = (numbers - 1) // SOURCES
        low, high, sums = [], [], []
        for i in range(len(numbers)):
            # within a block each pair once, across two blocks those of the first with those of the second
            others = np.flatnonzero(of == b) if a != b else np.arange(i + 1, len(numbers))
            if of[i] != a or not len(others):
                continue
            gap = grid[others] - grid[i]
            low.append(np.full(len(others), numbers[i]))
            high.append(numbers[others])
            sums.append((gap * gap // (grid[others] + grid[i])).sum(axis=1))
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        n = sum(map(len, low))
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "low": flat(low), "high": flat(high), "f": flat(sums), "terms": pa.array([width] * n, pa.int64())})

    found = paired.groupBy("lang", "terms_at", "a", "b").applyInArrow(block, "lang string, low long, high long, f long, terms long")
    return found.groupBy("lang", "low", "high").agg(F.sum("f").alias("f"), F.sum("terms").alias("terms"))


def divergence(docs: DataFrame, least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """Pairs of sources and telling terms of sources: lang, source, part, item, value, rank."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = settle(kept_terms(counted(texts), least))
    langs = kept.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    # one row per source of a language
    groups = settle(groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total",
        F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long").alias("no"), F.count("*").over(W.partitionBy("lang")).alias("sources"),
    ).withColumn("p0", F.when(F.col("terms") > 0, scaled(F.lit(0), F.col("total"), F.col("terms")))))
    cells = kept.join(groups, ["lang", "source"]).withColumn("p", scaled(F.col("n"), F.col("total"), F.col("terms")))

    q = scaled(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    telling = cells.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    telling = top_per_key(telling, ["lang", "source"], [F.desc("value"), F.asc("item")], shown)

    parts = F.expr(f"1 + terms div {TERMS}")
    marks = groups.where("terms > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("terms_at"), "no", "sources", F.lit(None).cast("string").alias("term"), "p0")
    blocks = cells.select("lang", F.pmod(F.xxhash64("term"), parts).alias("terms_at"), "no", "sources", "term", "p", "p0").unionByName(marks.withColumn("p", F.col("p0")))
    sums = pair_sums(blocks)
    left = groups.select("lang", "source", "no", "terms", F.col("p0").alias("p"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"), F.col("p0").alias("q"))
    # the result itself holds every pair of sources of a language
    pairs = left.join(right, "lang").where("no <> other").withColumn("low", F.least("no", "other")).withColumn("high", F.greatest("no", "other"))
    rest = (F.col("terms") - F.coalesce("held", F.lit(0))) * apart(F.col("p"), F.col("q"))
    pairs = pairs.join(sums.withColumnRenamed("terms", "held"), ["lang", "low", "high"], "left")
    pairs = pairs.select("lang", "source", "item", (F.coalesce("f", F.lit(0)) + F.coalesce(rest, F.lit(0))).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(telling.withColumn("part", F.lit("term")).select(*out))


OP11_SQL = f"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as id from documents),
w as (select lang, source, id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by 1, 2 having count(distinct id) >= {LEAST}),
l as (select lang, count(*) as v, sum(n) as total from kept group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by 1, 2, 3),
t as (select lang, source, sum(n) as total from c group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) as p, 1 + ({SCALE}::hugeint * (k.n + 2)) // (l.total + 2 * l.v) as q
  from g join kept k using (lang) join l using (lang) left join t on t.lang = g.lang and t.source = g.source
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(f.value, 0)::bigint as value
  from g join g h on g.lang = h.lang and g.source <> h.source left join f on f.lang = g.lang and f.source = g.source and f.item = h.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select * from r where part = 'pair' or rank <= {SHOWN}"""


@query("op11_divergence", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))
