"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws the exponential key ``-ln(u) / w`` with ``u`` from a hash of its id and ``w`` its
quality weight; within a source the documents stand in the order of their keys.  A source whose
target is ``e`` times its size and a rest gives ``e`` complete epochs, then the documents in key
order until their sizes reach the rest; the document in which the rest ends is taken if more than
half of it lies before that point.

The order is not sorted as a whole.  Keys are cut into ``BINS`` bins by a monotone map, the sizes of
the bins are summed, and only documents of the one bin in which the rest ends are ranked.

Defined results: null text has size 0 and is taken as 0.  A null source is a source of its own.  Rows
with one id draw one key and are ordered by size and text hash; equal rows are interchangeable.
Sources with no words have target 0.  An empty table gives no rows.  The operator adds its columns
under names that the input does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import free_name, table
from .registry import query

#: bins of keys in which sizes are summed before any order is needed
BINS = 1 << 16
#: parts into which the documents of a source are dealt where they meet its facts
PARTS = 64
#: a source is repeated at most so often
MOST_EPOCHS = 3.0


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null.

    White space becomes blanks, and a word is a blank followed by something else.
    """
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(blank, F.lit("[^ ]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1: less for each symbol of ``#*$%&|<>`` per word or so."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(8.0) * F.coalesce(symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from a key, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key, F.lit("null")), F.lit(seed)).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def capped_targets(sources: DataFrame, most: float = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): all sizes shared by weight, none above ``most`` times its size.

    A source is at its cap when its share is still above it after what the sources with a lower
    cap per weight left over is shared out again, so one pass in the order of cap per weight finds
    the level at which the rest is shared.
    """
    # a row per source, not per document
    order = Window.orderBy("ratio", "source")
    all_ = Window.partitionBy()
    ranked = (
        sources.withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(all_) - F.col("capped")) / F.col("open"))
        # the first source in this order that stays below its cap sets the level
        .withColumn("fits", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source", "level"))).over(all_)["level"])
    )
    return ranked.select(
        "source", "source_size", "weight",
        F.least(F.col("cap"), F.col("weight") * F.coalesce("fits", F.lit(float("inf")))).alias("target"),
    )


def by_code_point(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Add ``weight``: sources by code point, null last, take the weights in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))


def mix(docs: DataFrame, weights=by_code_point, seed: str = "mix", id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(doc_id, source, digest, size, source_size, target, taken) of every document.

    ``weights`` adds a column ``weight`` to a table (source, source_size).
    """
    text = F.col(text_column).cast("string")
    drawn = settle(
        docs.select(
            F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"),
            F.xxhash64(text).alias("digest"), word_count(text).alias("size"),
            (-F.ln(uniform(F.col(id_column).cast("string"), seed)) / quality(text)).alias("key"),
        ).withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * BINS).cast("int"))
    )
    bins = settle(drawn.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    # sources are few against documents; each has at most BINS rows here
    sources = capped_targets(weights(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))))
    sources = settle(
        sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    summed = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
    cut = _same_source(summed, sources.select("source", "rest")).where(
        "bin_size > 0 and before < rest and before + bin_size >= rest"
    ).select("source", F.col("bin").alias("cut_bin"), "before")
    facts = _same_source(sources, cut, "left")
    # a source may hold a third of all rows: its one row of facts goes to each of its parts
    dealt = facts.withColumnRenamed("source", "_source").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(PARTS)).cast("int")
    rows = drawn.withColumn("part", part).join(
        dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))
    ).drop("_source", "_part")
    ends = F.col("bin") == F.col("cut_bin")
    clear = rows.where(~F.coalesce(ends, F.lit(False))).withColumn(
        # without a bin in which the rest ends, the rest is nothing or, by rounding, everything
        "more", F.when(F.col("cut_bin").isNull(), F.col("rest") >= F.col("source_size")).otherwise(F.col("bin") < F.col("cut_bin"))
    )
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    last = rows.where(ends).withColumn("more", middle < F.col("rest"))
    return clear.unionByName(last).select(
        "doc_id", "source", "digest", "size", "source_size", "target",
        ((F.col("epochs") + F.col("more").cast("int")) * F.col("size")).cast("long").alias("taken"),
    )


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source``, where null equals null."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


_U = "((('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || 'mix'), 1, 12))::bigint)::double + 0.5) / 281474976710656.0"

OP8_SQL = f"""with recursive d as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    -ln({_U}) / greatest(0.1, 1.0 - 8.0 * coalesce((length(text) - length(translate(text, '#*$%&|<>', '')))::double / greatest(length(text), 1), 0)) as key from documents),
s as (select source, sum(size)::double as ss, [1.0, 2.0, 3.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from d group by source),
rounds as (
  select 0 as step, source, ss, w, null::double as fixed from s
  union all
  select step + 1, source, ss, w,
    case when fixed is not null then fixed
         when w * (sum(ss) over () - coalesce(sum(fixed) over (), 0)) / sum(case when fixed is null then w end) over () >= 3 * ss then 3 * ss end
  from rounds where step < (select count(*) from s) + 1),
f as (select * from rounds where step = (select count(*) from s) + 1),
t as (select source, ss, coalesce(fixed, w * (sum(ss) over () - coalesce(sum(fixed) over (), 0)) / sum(case when fixed is null then w end) over ()) as target from f),
p as (select d.doc_id, d.size, t.ss, t.target, floor(case when t.ss > 0 then t.target / t.ss else 0 end) as e,
  sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) - d.size / 2.0 as mid
  from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, ss::bigint as source_size, round(target, 4) as target,
  cast(case when size = 0 then 0 else (e + case when mid < target - e * ss then 1 else 0 end) * size end as bigint) as taken from p"""


@query("op8_mixing", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken"
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Rows of one id, source and text are interchangeable, so their counts are added up.
    """
    id_, source, digest, copies, copy = (free_name(docs, n) for n in ("_id", "_source", "_digest", "_copies", "_copy"))
    taken = mix(docs, **options).where("taken > 0").groupBy("doc_id", "source", "digest").agg(
        F.sum(F.col("taken") / F.col("size")).cast("int").alias(copies)
    ).select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("digest").alias(digest), copies)
    once = docs.dropDuplicates(["doc_id", "source", "text"])
    same = (
        F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source))
        & (F.xxhash64(F.col("text")) == F.col(digest))
    )
    joined = once.join(taken, same)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
