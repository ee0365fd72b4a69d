"""Merkle fixity audit of record archives and their replicas.

A record is one row of an archive: its archive, its offset and its bytes.  Records in the order of
their offsets are dealt to leaves of ``LEAF`` offsets; a leaf hashes its records, and every ``FAN`` nodes of a
level are hashed into one of the next, up to a root per archive.  An audit compares roots, and only below
nodes that differ does it look at the next level, down to the leaves and then to single records.

Nodes are numbered by ranges of offsets, not by rank, so no global order is needed, a lost record
changes only the nodes above it, and both replicas number alike.

Defined results: null bytes hash differently from empty ones.  Records at one offset are hashed in the
order of their digests, so ties and repeated rows are compared as multisets.  Null archives are one
archive; null offsets go to a leaf of their own (-1).  An empty table on one side makes all records of the other
missing; two empty tables give no rows.  Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import table
from .registry import query

#: offsets in a leaf, children of a node
LEAF = FAN = 16


def records(archive: DataFrame, group: Column, offset: Column, content: Column) -> DataFrame:
    """(grp, pos, digest) of every record."""
    text = content.cast("binary")
    return archive.select(
        F.coalesce(group.cast("string"), F.lit("")).alias("grp"), F.coalesce(offset.cast("long"), F.lit(-1)).alias("pos"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("digest"),
    )


def _hash(children: str, order: str) -> Column:
    """Digest of the children in order; a node has at most FAN different ones, each a short string."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, children))), lambda x: F.concat_ws(":", x[order], x[children])), ","), 256)


def tree(found: DataFrame) -> list[DataFrame]:
    """Levels (grp, node, digest) from single offsets up to the roots.

    Equal digests at an offset are counted first, so repeated rows stay one child.
    """
    counted = found.groupBy("grp", "pos", "digest").agg(F.count("*").alias("n")).withColumn("digest", F.concat_ws("x", "digest", "n"))
    level = settle(counted.groupBy("grp", F.col("pos").alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ","), 256).alias("digest")))
    levels = [level]
    width = LEAF
    while not level.where("node not in (0, -1)").isEmpty():
        up = F.when(F.col("node") < 0, F.lit(-1)).otherwise(F.floor(F.col("node") / width)).cast("long")
        level = settle(level.withColumn("parent", up).groupBy("grp", F.col("parent").alias("up")).agg(_hash("digest", "node").alias("digest")).withColumnRenamed("up", "node"))
        levels.append(level)
        width = FAN
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(grp, level, node, state) of every differing node: level 0 are single offsets.

    ``state`` is corrupt, missing (only on the left) or extra (only on the right).
    """
    a, b = tree(left), tree(right)
    while len(a) != len(b):
        short = min(a, b, key=len)
        up = F.when(F.col("node") < 0, F.lit(-1)).otherwise(F.floor(F.col("node") / FAN)).cast("long")
        short.append(settle(short[-1].withColumn("parent", up).groupBy("grp", F.col("parent").alias("up")).agg(_hash("digest", "node").alias("digest")).withColumnRenamed("up", "node")))
    wrong: DataFrame | None = None
    out: DataFrame | None = None
    for depth in range(len(a) - 1, -1, -1):
        l, r = a[depth], b[depth]
        if wrong is not None:
            width = LEAF if depth == 0 else FAN
            parent = F.when(F.col("node") < 0, F.lit(-1)).otherwise(F.floor(F.col("node") / width)).cast("long")
            above = wrong.select("grp", F.col("node").alias("parent"))
            l, r = (x.withColumn("parent", parent).join(above, ["grp", "parent"], "left_semi").drop("parent") for x in (l, r))
        both = l.join(r.withColumnRenamed("digest", "other"), ["grp", "node"], "full")
        wrong = settle(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select(
            "grp", F.lit(depth).alias("level"), "node",
            F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt").alias("state"),
        ))
        out = wrong if out is None else out.unionByName(wrong)
        if wrong.isEmpty():
            break
    return out


OP2_SQL = """with p as (select coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') as grp, page_id as node, html,
  crc32_rest from (select *, page_id % 97 as crc32_rest from pages)),
x as (select grp, node, 'missing' as state from p where crc32_rest = 13 union all select grp, node, 'corrupt' from p where crc32_rest = 29 and length(html) > 0)
select grp, node as pos, state from x"""


@query("op2_fixity", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Audits the pages of each host against a replica in which known records are lost or altered."""
    pages = table(spark, folder, "pages").select("page_id", "html", F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("")).alias("host"))
    rest = F.col("page_id") % 97
    altered = F.when((rest == 29) & (F.length("html") > 0), F.concat(F.expr("substring(html, 2)"), F.lit("\x00"))).otherwise(F.col("html"))
    replica = pages.where(~F.coalesce(rest == 13, F.lit(False))).withColumn("html", altered)
    args = (F.col("host"), F.col("page_id"), F.col("html"))
    found = audit(records(pages, *args), records(replica, *args))
    return found.where("level = 0").select("grp", F.col("node").alias("pos"), "state")
