"""Consolidation: trace clusters, entity graph, lifecycle, capacity, summary levels, novelty."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.common import iso_date, let, words3
from ..plans.ordered import RANGE, in_ranges, neighbours, row_index, running_sums
from ..plans.scale import best_per_key, by_score, top_per_key
from ..session import settle


def analyze_traces(traces: DataFrame, projects: dict[str, list[str]] | None = None) -> DataFrame:
    """Metadata, entities, key lines and paragraphs of (name, text)."""
    m, c = F.col("_m"), F.col("text")
    return traces.withColumn("_m", T.trace_metadata(F.col("name"), projects)).select(
        "name", "text", m["date"].alias("date"), m["project"].alias("project"), m["type"].alias("type"),
        T.trace_entities(c, projects).alias("entities"), T.extract_key_lines(c).alias("key_lines"),
        T.trace_paragraphs(c).alias("paragraphs"),
    )


def cluster_traces(traces: DataFrame, max_gap_days: int = 2) -> DataFrame:
    """Add ``cluster`` (numbered within the project): a gap above two days starts a new one.

    Traces are ordered by date and name; an unreadable date counts as no gap.
    """
    order = ["date", "name"]
    near = neighbours(traces, ["project"], order, before={"_prev": F.col("date")})
    gap = F.abs(F.datediff(iso_date(F.col("date")), iso_date(F.col("_prev"))))
    starts = near.withColumn("_new", F.when(F.coalesce(gap, F.lit(0)) > max_gap_days, 1).otherwise(0)).drop("_prev")
    return running_sums(starts, ["project"], order, {"cluster": F.col("_new")}).drop("_new")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """One row per cluster: first date, most common type (first seen on a tie), sizes."""
    key = ["project", "cluster"]
    types = clustered.groupBy(*key, "type").agg(F.count("*").alias("n"), F.min(F.struct("date", "name")).alias("at"))
    mode = best_per_key(types, key, [F.desc("n"), F.asc("at")]).select(*key, F.col("type").alias("main_type"))
    size = clustered.groupBy(*key).agg(F.count("*").alias("n_traces"), F.min("date").alias("date"))
    names = cluster_entities(clustered).groupBy(*key).agg(F.count("*").alias("n_entities"))
    lines = cluster_lines(clustered).groupBy(*key).agg(F.count("*").alias("n_key_lines"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    category = F.when(F.col("main_type") == "general", "findings").otherwise(F.col("main_type"))
    return size.join(mode, key).join(names, key, "left").join(lines, key, "left").select(
        *key, "date", "main_type", category.alias("category"), "n_traces", zero("n_entities"), zero("n_key_lines")
    )


def cluster_entities(clustered: DataFrame) -> DataFrame:
    """Distinct (project, cluster, entity)."""
    return clustered.select("project", "cluster", F.explode("entities").alias("entity")).distinct()


def cluster_lines(clustered: DataFrame) -> DataFrame:
    """Distinct key lines of a cluster with their first place (date, name, position)."""
    rows = clustered.select("project", "cluster", "date", "name", F.posexplode("key_lines").alias("i", "line"))
    return rows.groupBy("project", "cluster", "line").agg(F.min(F.struct("date", "name", "i")).alias("at"))


def semantic_memories(clustered: DataFrame) -> DataFrame:
    """Content parts of each cluster's memory in writing order: (project, cluster, section, at, content).

    Parts stay rows, so a cluster of any size is written by several tasks.
    """
    lines = cluster_lines(clustered).select("project", "cluster", F.lit("finding").alias("section"), "at", F.concat(F.lit("- "), "line").alias("content"))
    paras = clustered.select("project", "cluster", "date", "name", F.posexplode("paragraphs").alias("i", "content")).select(
        "project", "cluster", F.lit("full").alias("section"), F.struct("date", "name", "i").alias("at"), "content"
    )
    return lines.unionByName(paras)


def memory_records(clustered: DataFrame, today: str, state: str = "active", confidence: float = 0.8) -> DataFrame:
    """One memory per cluster with its place and lifecycle fields.

    ``memory_id`` is the file name by date, project and type.  Of clusters with one file the later one counts, as it is written last.
    """
    rows = cluster_summary(clustered)
    topic = F.substring(F.regexp_replace(F.lower(F.concat("project", F.lit("-"), "main_type")), "[^a-z0-9_-]", "-"), 1, 60)
    named = rows.select(
        "category", F.concat("date", F.lit("_"), topic, F.lit(".md")).alias("memory_id"), "project", "cluster", "date", "n_traces", "n_entities", "n_key_lines",
        F.lit(confidence).alias("confidence"), F.lit(state).alias("validity_state"), F.lit(today).alias("last_validated"), F.lit(today).alias("last_accessed"),
    )
    return best_per_key(named, ["category", "memory_id"], [F.desc("cluster"), F.desc("project")])


def entity_table(traces: DataFrame, project_names: list[str] | None = None) -> DataFrame:
    """(id, type, label, first_seen, trace_count) over traces with name, date and entities, or over :func:`counted_graph`."""
    if "n" in traces.columns:
        rows, n = traces.where("target is null").select("date", F.col("source").alias("id"), "n"), F.sum("n")
    else:
        rows, n = traces.select("date", F.explode(F.array_distinct("entities")).alias("id")), F.count("*")
    kind = F.when(F.col("id").isin(project_names or []), "project").otherwise("concept")
    return rows.groupBy("id").agg(F.min("date").alias("first_seen"), n.alias("trace_count")).select(
        "id", kind.alias("type"), F.col("id").alias("label"), "first_seen", "trace_count"
    )


def trace_relations(traces: DataFrame) -> DataFrame:
    """(name, date, source, target, type) for the entity pairs of each trace, source <= target."""
    pairs = traces.select("name", "date", F.inline_outer(T.extract_relations(F.col("text"), F.col("entities"), max_gap=None)))
    # outer, so that the optimizer does not test the array's size with a second evaluation
    pairs = pairs.where("source is not null")
    return pairs.select(
        "name", "date", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"),
        F.col("relation").alias("type"),
    )


def counted_graph(traces: DataFrame) -> DataFrame:
    """(source, target, type, date, name, n): pairs of :func:`trace_relations` and, without target, entities, counted in one pass.

    ``traces`` has name, date, text and entities, which are read once for both tables of the graph.  ``date`` and ``name`` are those of
    the first trace, the earliest date for an entity.
    """
    pair = lambda p: F.struct(
        F.least(p["source"], p["target"]).alias("source"), F.greatest(p["source"], p["target"]).alias("target"), p["relation"].alias("type")
    )
    none = F.lit(None).cast("string")
    entity = lambda e: F.struct(e.alias("source"), none.alias("target"), none.alias("type"))

    def both(entities: Column) -> Column:
        pairs = F.transform(T.extract_relations(F.col("text"), entities, max_gap=None), pair)
        return F.concat(F.transform(F.array_distinct(entities), entity), pairs)

    rows = traces.select("name", "date", F.inline_outer(let(F.col("entities"), both))).where("source is not null")
    typed = F.col("target").isNotNull()
    return rows.groupBy("source", "target", "type").agg(
        F.min(F.when(typed, F.struct("date", "name"))).alias("at"), F.min("date").alias("day"), F.count("*").alias("n")
    ).select(
        "source", "target", "type", F.when(typed, F.col("at.date")).otherwise(F.col("day")).alias("date"), F.col("at.name").alias("name"), "n"
    )


def relation_table(pairs: DataFrame) -> DataFrame:
    """(source, target, type, weight): weight counts traces, the first typed relation wins.

    The traces behind an edge stay rows of ``pairs``; they are not gathered into an array.  ``pairs`` may be counted ones.
    """
    counted = "n" in pairs.columns
    pairs = pairs.where("target is not null") if counted else pairs
    typed = F.col("type") != "co_occurs"
    return pairs.groupBy("source", "target").agg(
        F.min(F.when(typed, F.struct("date", "name", "type"))).alias("_t"), (F.sum("n") if counted else F.count("*")).alias("weight")
    ).select("source", "target", F.coalesce(F.col("_t.type"), F.lit("co_occurs")).alias("type"), "weight")


def upsert_relations(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add new relation weights to stored ones; an untyped edge takes a new type."""
    both = stored.select("source", "target", "type", "weight", F.lit(0).alias("o")).unionByName(
        fresh.select("source", "target", "type", "weight", F.lit(1).alias("o"))
    )
    typed = F.col("type") != "co_occurs"
    return both.groupBy("source", "target").agg(
        F.min(F.when(typed, F.struct("o", "type"))).alias("_t"), F.sum("weight").alias("weight")
    ).select("source", "target", F.coalesce(F.col("_t.type"), F.lit("co_occurs")).alias("type"), "weight")


# ---- lifecycle --------------------------------------------------------------------------------------


def next_state(state: Column, last_access: Column, ref: Column) -> Column:
    age = F.datediff(ref, last_access)
    return (
        F.when(state.isin("active", "validated") & (age > fixed.STALE_AFTER_DAYS), "stale")
        .when((state == "stale") & (age > fixed.ARCHIVE_AFTER_DAYS), "archived")
        .otherwise(state)
    )


def age_memories(memories: DataFrame, ref: Column) -> tuple[DataFrame, DataFrame]:
    """(memories with their new state, counts per transition)."""
    aged = memories.withColumn("new_state", next_state(F.col("validity_state"), F.col("last_accessed"), ref))
    moved = aged.where("new_state <> validity_state").groupBy(
        F.concat_ws("_to_", "validity_state", "new_state").alias("transition")
    ).agg(F.count("*").alias("n"))
    return aged, moved


def capacity_report(memories: DataFrame) -> DataFrame:
    """Characters, limit and use per category, with files per state."""
    limits = F.create_map(*[F.lit(x) for kv in fixed.CATEGORY_CHAR_LIMITS.items() for x in kv])
    limit = F.coalesce(F.try_element_at(limits, F.col("category")), F.lit(fixed.DEFAULT_CATEGORY_CHAR_LIMIT))
    states = ["active", "validated", "stale", "archived"]
    per = memories.groupBy("category").agg(
        F.sum(F.length("content")).alias("chars"), F.count("*").alias("file_count"),
        *[F.count_if(F.col("validity_state") == s).alias(s) for s in states],
    )
    pct = F.round(100 * F.col("chars") / limit, 1)
    return per.select(
        "category", "chars", limit.alias("char_limit"), pct.alias("usage_pct"),
        (pct >= fixed.CAPACITY_WARN_PERCENT).alias("needs_consolidation"), "file_count", *states,
    )


# ---- summary levels -------------------------------------------------------------------------------------


def summary_levels(traces: DataFrame, fanout: int = 4) -> DataFrame:
    """Tree of summaries: (node_id, level, pos, summary, children, first, last, entities, project).

    Leaves are the traces in date and name order; each parent joins ``fanout`` neighbours.  Every
    level groups by position, so groups never exceed the fan-out.  Of equally common projects the
    alphabetically first counts.
    """
    day = F.substring("date", 1, 10)
    text = F.when(F.size("key_lines") > 0, F.array_join(F.slice("key_lines", 1, 5), " ")).otherwise(F.substring("text", 1, 200))
    leaves = row_index(
        traces.select(
            "name", "date", F.concat(F.lit("L0_"), "name").alias("node_id"), text.alias("summary"),
            F.array("name").alias("children"), day.alias("first"), day.alias("last"),
            F.slice("entities", 1, 20).alias("entities"), "project",
        ),
        [], ["date", "name"],
    )
    cols = ["node_id", "level", "pos", "summary", "children", "first", "last", "entities", "project"]
    level = settle(leaves.withColumn("level", F.lit(0)).select(*cols))
    out, depth, size = level, 0, level.count()
    while size > 1:
        depth += 1
        group = level.groupBy(F.floor((F.col("pos") - 1) / fanout).alias("g")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "node_id", "summary", "entities", "project"))).alias("c"),
            F.min(F.nullif("first", F.lit(""))).alias("first"), F.max(F.nullif("last", F.lit(""))).alias("last"),
        )
        c = F.col("c")
        names = F.transform(c, lambda x: x["project"])
        main = F.array_min(
            F.transform(c, lambda x: F.struct((-F.size(F.filter(names, lambda p: p == x["project"]))).alias("n"), x["project"].alias("p")))
        )["p"]
        level = settle(
            group.select(
                F.concat_ws("_", F.lit(f"L{depth}"), F.col("g").cast("string"), F.coalesce("first", F.lit("9999"))).alias("node_id"),
                F.lit(depth).alias("level"), (F.col("g") + 1).alias("pos"),
                F.array_join(F.transform(c, lambda x: F.substring(x["summary"], 1, 100)), " | ").alias("summary"),
                F.transform(c, lambda x: x["node_id"]).alias("children"),
                F.coalesce("first", F.lit("")).alias("first"), F.coalesce("last", F.lit("")).alias("last"),
                F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda x: x["entities"])))), 1, 30).alias("entities"),
                main.alias("project"),
            ).select(*cols)
        )
        out = out.unionByName(level)
        size = -(-size // fanout)
    return out


def search_levels(nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, node_id, score, rank): leaves reached from the top through nodes that share a word."""
    top = nodes.agg(F.max("level")).first()[0]
    asked = queries.select("query_id", words3(F.col("query")).alias("q"))
    words = nodes.select(
        "node_id", "level", "children", words3(F.concat_ws(" ", "summary", F.array_join("entities", " "))).alias("w")
    )
    hits = words.select("node_id", "level", "children", F.explode("w").alias("token")).join(
        asked.select("query_id", F.explode("q").alias("token")), "token"
    ).groupBy("query_id", "node_id", "level").agg(F.count("*").cast("double").alias("score"), F.first("children").alias("children"))
    hits = settle(hits)
    # the reference order: best nodes first on the top level, then the children of each in turn
    frontier = top_per_key(hits.where(F.col("level") == top), ["query_id"], by_score("node_id"), k).select(
        "query_id", "node_id", "score", "children", F.array(F.struct((-F.col("score")).alias("s"), F.col("node_id").alias("n"))).alias("path")
    )
    for level in range(top - 1, -1, -1):
        step = frontier.select("query_id", "path", F.explode("children").alias("node_id")).join(
            hits.where(F.col("level") == level).select("query_id", "node_id", "score", "children"), ["query_id", "node_id"]
        )
        frontier = step.select(
            "query_id", "node_id", "score", "children",
            F.concat("path", F.array(F.struct((-F.col("score")).alias("s"), F.col("node_id").alias("n")))).alias("path"),
        )
    return top_per_key(frontier, ["query_id"], [F.asc("path")], k).select("query_id", "node_id", "score", "rank")


# ---- novelty ------------------------------------------------------------------------------------------------


def novelty(patterns: DataFrame, order: str = "seq", vector: str = "embedding") -> DataFrame:
    """Add ``novelty``: 1 - cosine of each vector to the mean of all vectors before it.

    The first vector has novelty 1.  A zero vector has novelty 1 and is not added.  Sums per range
    are exchanged, then every range replays its rows with a running sum.
    """
    clean = patterns.withColumn("_v", F.transform(vector, lambda x: x.cast("double")))
    ranged = in_ranges(clean, [], [order])
    size = ranged.agg(F.max(F.size("_v"))).first()[0] or 0
    live = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x) >= 1e-24
    sums = ranged.where(live).groupBy(RANGE).agg(
        F.count("*").alias("n"), *[F.sum(F.col("_v")[i]).alias(f"v{i}") for i in range(size)]
    ).orderBy(RANGE).toPandas()  # one row per range
    totals = {int(r[RANGE]): (float(r["n"]), r[[f"v{i}" for i in range(size)]].to_numpy(dtype=float)) for _, r in sums.iterrows()}
    starts, n, acc = {}, 0.0, np.zeros(size)
    for part in range(max(totals, default=-1) + 1):
        starts[part] = (n, acc.copy())
        if part in totals:
            n, acc = n + totals[part][0], acc + totals[part][1]
    schema = patterns.drop(vector).schema.add("novelty", "double")
    keep = [c for c in patterns.columns if c != vector]

    def replay(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        count, total = starts.get(int(key[0]), (0.0, np.zeros(size)))
        v = np.array(frame["_v"].tolist(), dtype=float).reshape(len(frame), size)
        norm = np.sqrt((v * v).sum(axis=1))
        used = (norm >= 1e-12).astype(float)
        before = total + np.cumsum(v * used[:, None], axis=0) - v * used[:, None]
        seen = count + np.cumsum(used) - used
        b = np.sqrt((before * before).sum(axis=1))
        cos = (before * v).sum(axis=1) / np.where((b > 0) & (norm > 0), b * norm, 1.0)
        mean_norm = b / np.maximum(seen, 1.0)
        value = np.where((seen == 0) | (norm < 1e-12) | (mean_norm < 1e-12), 1.0, 1.0 - cos)
        return frame[keep].assign(novelty=value)

    return ranged.groupBy(RANGE).applyInPandas(replay, schema)


