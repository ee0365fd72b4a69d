"""Deep recall: semantic memories, entity neighbourhood, order neighbours, cross-project links."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.common import extract_all, strip
from ..plans.graph import both_ways
from ..plans.ordered import row_index
from ..plans.scale import best_per_key, ranked, top_per_key
from ..session import settle
from .search import entities_in_text, token_share_search

#: names whose neighbours are looked for in the tasks; for more of them all names are placed
COPIED = 4096


def semantic_search(memories: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Memory files by the share of query words they hold, with their first key point.

    ``memories`` has item_id and text (frontmatter and body).
    """
    words = lambda c: F.array_distinct(extract_all(F.lower(c), r"(?U)\w+"))
    found = settle(token_share_search(memories, queries, k, tokens=words))
    # only the memories that were found are read in full
    memories = memories.select("item_id", "text").join(found.select("item_id").distinct(), "item_id", "left_semi")
    body = strip(F.regexp_replace("text", r"(?s)^---.*?---", ""))
    bullets = F.filter(
        F.transform(F.split(body, "\n", -1), strip), lambda s: s.startswith("- ") & (F.length(s) > 20)
    )
    point = strip(F.regexp_replace(F.get(bullets, F.lit(0)), r"^[\- ]+", ""))
    front = T.frontmatter(F.col("text"))
    details = memories.select(
        "item_id", F.coalesce(point, F.lit("")).alias("key_point"), F.coalesce(front["project"], F.lit("")).alias("project"),
        F.substring(body, 1, 1000).alias("content"),
    )
    return found.join(details, "item_id")


def related_entities(asked: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, entity, other, type, weight, rank): strongest neighbours of each asked entity.

    ``asked`` has (query_id, entity).  A hub's edges are cut to k per partition before they move.
    """
    edges = both_ways(relations.select("source", "target", "type", "weight"), "source", "target")
    near = edges.withColumnRenamed("source", "entity").withColumnRenamed("target", "other").join(asked, "entity")
    order = [F.desc("weight"), F.asc("other"), F.asc("type")]
    return top_per_key(near, ["query_id", "entity"], order, k)


def related_of_query(asked: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, other, type, weight, rank): the k strongest neighbours over all entities of a query."""
    best = best_per_key(
        related_entities(asked, relations, k), ["query_id", "other"], [F.desc("weight"), F.asc("type")]
    ).select("query_id", "other", "type", "weight")
    return top_per_key(best, ["query_id"], [F.desc("weight"), F.asc("other")], k)


def graph_edges(relations: DataFrame, entity: str = "", k: int = 10) -> DataFrame:
    """Strongest edges, of one entity when given."""
    rows = relations if not entity else relations.where((F.col("source") == entity) | (F.col("target") == entity))
    return rows.orderBy(F.desc("weight"), "source", "target").limit(k)


def _around(traces: DataFrame, asked: list[str], reach: int) -> DataFrame:
    """The names next to those asked for, up to ``reach`` on each side in every task, with repeats."""
    asked = sorted(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nulls, near = 0, []
        for batch in batches:
            names = batch.column(0)
            nulls = min(reach, nulls + names.null_count)
            rows = sorted(near + names.drop_null().to_pylist())
            kept: set[int] = set()
            for name in asked:
                kept.update(range(max(0, bisect_left(rows, name) - reach), min(len(rows), bisect_right(rows, name) + reach)))
            near = [rows[i] for i in sorted(kept)]
        yield pa.RecordBatch.from_arrays([pa.array([None] * nulls + near, pa.string())], names=["name"])

    return traces.select("name").mapInArrow(run, "name string")


def order_neighbours(traces: DataFrame, reach: int = 3, asked: DataFrame | None = None) -> DataFrame:
    """(name, other, distance): up to three names before (negative) and after each name.

    With ``asked`` (name) only for these names; if they are few, no other names than those around them are placed.
    """
    names = traces.select("name")
    if asked is not None:
        asked = asked.where("name is not null").select("name").distinct()
        few = [r.name for r in asked.limit(COPIED + 1).collect()]
        if len(few) <= COPIED:
            # what lies between two of these names is here, so places differ as they do among all names
            names = settle(_around(names, few, reach))
    placed = row_index(names, [], ["name"])
    steps = [d for d in range(-reach, reach + 1) if d]
    own = placed if asked is None else placed.join(asked, "name", "left_semi")
    wanted = own.select(
        "name", F.col("pos").alias("_p"), F.explode(F.array(*[F.lit(d) for d in steps])).alias("distance")
    ).select("name", "distance", (F.col("_p") + F.col("distance")).alias("pos"))
    return wanted.join(placed.select(F.col("name").alias("other"), "pos"), "pos").select("name", "other", "distance")


def cross_project(asked: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, project, weight, n_shared, rank): other projects linked to the entities of a query.

    ``asked`` has (query_id, entity, place); the entity in the first place is the primary project.
    """
    near = related_entities(asked.select("query_id", "entity"), relations, 20)
    projects = entities.where("type = 'project'").select(F.col("id").alias("other"))
    primary = asked.where("place = 0").select("query_id", F.col("entity").alias("other"))
    hits = near.join(projects, "other", "left_semi").join(primary, ["query_id", "other"], "left_anti")
    first = best_per_key(
        hits.join(asked, ["query_id", "entity"]), ["query_id", "other"], [F.asc("place"), F.asc("rank")]
    ).select("query_id", F.col("other").alias("project"), "weight")
    edges = both_ways(relations.select("source", "target"), "source", "target")
    shared = (
        first.join(edges.select(F.col("source").alias("project"), F.col("target").alias("entity")), "project")
        .join(asked.select("query_id", "entity"), ["query_id", "entity"], "left_semi")
        .groupBy("query_id", "project").agg(F.count("*").alias("n_shared"))
    )
    full = first.join(shared, ["query_id", "project"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return top_per_key(full, ["query_id"], [F.desc("weight"), F.asc("project")], k)


def entities_of_query(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity, place): entities named in each query, in id order."""
    found = entities_in_text(queries, "query_id", F.col("query"), entities)
    return ranked(found, ["query_id"], [F.asc("id")]).select(
        "query_id", F.col("id").alias("entity"), (F.col("rank") - 1).alias("place")
    )


def novelty_of_query(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, novelty): share of the longer query words that no entity is known by."""
    known = entities.select(F.col("id").alias("w")).unionByName(
        entities.select(F.explode(extract_all(F.lower(F.coalesce("label", F.lit(""))), r"(?U)\w{4,}")).alias("w"))
    ).distinct()
    words = queries.select(
        "query_id", F.explode_outer(F.array_distinct(extract_all(F.lower("query"), r"(?U)\w{4,}"))).alias("w")
    )
    hits = words.join(known.withColumn("hit", F.lit(1)), "w", "left")
    n = F.count("w")
    return hits.groupBy("query_id").agg(
        F.when(n > 0, (n - F.count("hit")) / n).otherwise(0.0).alias("novelty")
    )


def deep_recall(
    results: DataFrame, queries: DataFrame, memories: DataFrame, entities: DataFrame, relations: DataFrame,
    traces: DataFrame,
) -> DataFrame:
    """One row per query with its best trace, memories, entities, neighbours and novelty.

    ``results`` holds the first search result (query_id, name, score).  All parts are short lists.
    """
    best = results.where("rank = 1").select("query_id", F.col("name").alias("trace"), "score")
    texts = queries.select("query_id", "query").unionByName(
        best.join(traces.select(F.col("name").alias("trace"), "text"), "trace").select("query_id", F.col("text").alias("query"))
    )
    asked = ranked(
        entities_in_text(texts, "query_id", F.col("query"), entities).distinct(), ["query_id"], [F.asc("id")]
    ).select("query_id", F.col("id").alias("entity"), (F.col("rank") - 1).alias("place"))
    lists = lambda df, item, out: df.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("v")))), lambda x: x["v"]).alias(out)
    )
    near = order_neighbours(traces, asked=best.select(F.col("trace").alias("name"))).join(best.withColumnRenamed("trace", "name"), "name")
    around = near.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("distance") < 0, F.struct("distance", "other")))), lambda x: x["other"]).alias("before"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("distance") > 0, F.struct("distance", "other")))), lambda x: x["other"]).alias("after"),
    )
    parts = [
        best, lists(semantic_search(memories, queries, 5), "key_point", "key_points"),
        lists(asked.withColumn("rank", F.col("place")), "entity", "entities"),
        lists(related_of_query(asked.select("query_id", "entity"), relations), "other", "related"),
        around, lists(cross_project(asked, entities, relations), "project", "cross_project"),
        novelty_of_query(queries, entities),
    ]
    out = queries.select("query_id", "query")
    for p in parts:
        out = out.join(p, "query_id", "left")
    return out


