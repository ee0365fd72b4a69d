"""Reader contexts: session selection, lean and layered contexts, digests, budget packing.

Each works on the head of a ranking, cut to its limit before anything is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed
from ..functions.common import extract_all, iso_date, let, strip, str_array
from ..plans.scale import best_per_key, growing, ranked, top_per_key


def rank_sessions(results: DataFrame) -> DataFrame:
    """(query_id, session_idx, session_rank): sessions by their best result."""
    best = results.groupBy("query_id", "session_idx").agg(F.min("rank").alias("best"))
    return ranked(best, ["query_id"], [F.asc("best"), F.asc("session_idx")], "session_rank")


def _greedy(items: Column, budget: int, cost: str) -> Column:
    """Indexes kept when items are taken in order as long as they fit; a too large one is skipped.

    The first item is always kept.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        size = x[cost].cast("long")
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + size <= budget)
        return F.when(
            fits,
            F.struct((acc["used"] + size).alias("used"), F.concat(acc["kept"], F.array(x["session_idx"].cast("bigint"))).alias("kept")),
        ).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def select_sessions(
    results: DataFrame, session_sizes: DataFrame, max_sessions: int = 10, char_budget: int = 80_000
) -> DataFrame:
    """(query_id, session_idx, session_rank, state): selected, over_limit or over_budget.

    ``session_sizes`` has query_id, session_idx and n_chars of the rendered session.
    """
    known = rank_sessions(results).join(session_sizes, ["query_id", "session_idx"])
    # sessions that are unknown give up their place
    placed = ranked(known, ["query_id"], [F.asc("session_rank")], "place")
    head = placed.where(F.col("place") <= max_sessions).select(
        "query_id", "session_idx", "place", (F.col("n_chars") + 2).alias("cost")
    )
    kept = head.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "session_idx", "cost"))).alias("items")
    ).select("query_id", _greedy(F.col("items"), char_budget, "cost").alias("kept"))
    state = (
        F.when(F.col("place") > max_sessions, "over_limit")
        .when(F.array_contains("kept", F.col("session_idx").cast("bigint")), "selected")
        .otherwise("over_budget")
    )
    return placed.join(kept, "query_id").select("query_id", "session_idx", F.col("place").alias("session_rank"), state.alias("state"))


def rendered_size(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Characters of each rendered session: header, role tags, texts and line ends."""
    line = F.length("role") + F.length("text") + 4
    header = F.length(F.lit("=== Session 0 ===")) + F.when(F.first("session_date") != "", F.length(F.first("session_date")) + 3).otherwise(0)
    return turns.groupBy(*keys).agg((F.sum(line) + F.count("*") + header).alias("n_chars"))


def fact_date(mentions: Column, valid_from: Column, session_date: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.get(mentions, F.lit(0)), blank(valid_from), blank(session_date), F.lit(""))


def statement_key(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")
    return F.regexp_replace(flat, r"^[ .,:;\-]+|[ .,:;\-]+$", "")


LEAN_HEADER = "OBSERVATIONS (lean, deduplicated, newest first; [superseded] = no longer valid):"


def lean_context(
    facts: DataFrame, max_observations: int = 40, char_budget: int = 8000, drop_superseded: bool = False
) -> DataFrame:
    """(scope, pos, date, text, superseded): newest statements first, until count or budget is used.

    Repeated statements keep the most confident one, the earlier on a tie.
    """
    header = len(LEAN_HEADER)
    clean = F.regexp_replace(strip(F.col("text")), r"(?U)\s+", " ")
    rows = facts.select(
        "scope", "fact_idx", "confidence", statement_key(F.col("text")).alias("key"), clean.alias("text"),
        (F.coalesce("valid_until", F.lit("")) != "").alias("superseded"),
        fact_date(F.col("date_mentions"), F.col("valid_from"), F.coalesce("session_date", F.lit(""))).alias("date"),
    ).where("key <> ''")
    first = rows.groupBy("scope", "key").agg(F.min("fact_idx").alias("first"))
    best = best_per_key(rows, ["scope", "key"], [F.desc("confidence"), F.asc("fact_idx")]).join(first, ["scope", "key"])
    if drop_superseded:
        best = best.where("not superseded")
    order = [F.desc("date"), F.asc("superseded"), F.asc("first")]
    head = top_per_key(best, ["scope"], order, max_observations, "pos")
    when = F.when(F.col("date") != "", F.length("date")).otherwise(7)
    size = F.length("text") + when + 6 + F.when(F.col("superseded"), 13).otherwise(0)
    items = head.withColumn("size", size).groupBy("scope").agg(
        F.array_sort(F.collect_list(F.struct("pos", "size", "date", "text", "superseded"))).alias("items")
    )
    # the first line always stays; the list ends before the first one that would overflow
    taken = F.aggregate(
        "items", F.struct(F.lit(header).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("stop")),
        lambda acc, x: F.when(
            acc["stop"] | ((acc["n"] > 0) & (acc["used"] + x["size"] > char_budget)),
            F.struct(acc["used"].alias("used"), acc["n"].alias("n"), F.lit(True).alias("stop")),
        ).otherwise(F.struct((acc["used"] + x["size"]).alias("used"), (acc["n"] + 1).alias("n"), F.lit(False).alias("stop"))),
        lambda acc: acc["n"],
    )
    return items.select("scope", F.inline(F.slice("items", F.lit(1), taken))).drop("size")


def layer(valid_from: Column, session_date: Column, confidence: Column, ref: Column) -> Column:
    """top_of_mind, work_context, stable or background by age and confidence."""
    day = F.coalesce(iso_date(valid_from), D.session_date(F.coalesce(session_date, F.lit(""))))
    age = F.datediff(ref, day)
    rest = F.when(confidence > 0.8, "stable").otherwise("background")
    return F.when(age <= 1, "top_of_mind").when(age <= 7, "work_context").otherwise(rest)


def layered_context(facts: DataFrame, ref: Column, total: int = 20) -> DataFrame:
    """Facts per layer, cut to the layer's share of ``total`` lines."""
    shares = {"top_of_mind": 0.30, "work_context": 0.30, "stable": 0.25, "background": 0.15}
    tagged = facts.withColumn("layer", layer(F.col("valid_from"), F.col("session_date"), F.col("confidence"), ref))
    limit = None
    for name, share in shares.items():
        n = max(1, int(total * share))
        limit = F.when(F.col("layer") == name, n) if limit is None else limit.when(F.col("layer") == name, n)
    return top_per_key(tagged, ["scope", "layer"], [F.asc("fact_idx")], total, "pos").where(F.col("pos") <= limit)


def _significant(c: Column) -> Column:
    tokens = F.filter(extract_all(F.lower(c), "[a-z0-9]+"), lambda t: F.length(t) >= 4)
    return F.array_except(tokens, str_array(fixed.SYNTHESIS_STOPWORDS))


def statements() -> dict[str, Column]:
    """What :func:`entity_digests` reads of a fact: text, digest of the statement, date and the entities with longer words."""
    flat = lambda c: F.regexp_replace(strip(c), r"(?U)\s+", " ")
    mentions = F.transform(
        F.transform("entities", lambda name: F.lower(flat(name))),
        lambda e, i: F.struct(i.alias("i"), e.alias("entity"), _significant(e).alias("words")),
    )
    return {
        "session_idx": F.col("session_idx"), "text": flat(F.col("text")),
        "digest": let(statement_key(F.col("text")), lambda k: F.when(k != "", F.unhex(F.md5(k)))),
        "date": fact_date(F.col("date_mentions"), F.col("valid_from"), F.coalesce("session_date", F.lit(""))),
        "mentions": F.filter(mentions, lambda m: F.size(m["words"]) > 0),
    }


def entity_digests(
    facts: DataFrame, questions: DataFrame, max_entities: int = 4, max_statements: int = 4
) -> DataFrame:
    """(query_id, entity, entity_rank, pos, date, text): dated statements about the asked entities.

    An entity is asked for when one of its longer words is in the question; it needs two different
    statements.  Temporal questions get no digest.  ``facts`` are the retrieved facts with
    query_id, rank and the columns of :func:`statements`, or those of the facts themselves.  Every step is by question, so facts
    that are partitioned by question stay where they are.
    """
    if "mentions" not in facts.columns:
        facts = facts.select("query_id", "rank", *[c.alias(n) for n, c in statements().items()])
    asked = questions.where("qtype <> 'temporal-reasoning'").select("query_id", _significant(F.col("question")).alias("q"))
    grounded = facts.where("digest is not null").join(growing(asked), "query_id").select(
        "query_id", "rank", "session_idx", "text", "digest", "date",
        F.inline(F.filter("mentions", lambda m: F.arrays_overlap(m["words"], F.col("q")))),
    )
    once = best_per_key(grounded.drop("words"), ["query_id", "entity", "digest"], [F.asc("rank"), F.asc("i")])
    order = [F.asc(F.col("date") == ""), F.asc("date"), F.asc("session_idx"), F.asc("rank")]
    per = W.partitionBy("query_id", "entity")
    lines = once.select(
        "query_id", "entity", "date", "text", F.row_number().over(per.orderBy(*order)).alias("pos"),
        F.least(F.count("*").over(per), F.lit(max_statements)).alias("n"), F.min(F.struct("rank", "i")).over(per).alias("seen"),
    ).where((F.col("n") >= 2) & (F.col("pos") <= max_statements))
    # no two entities of a question are first seen at one place
    place = F.dense_rank().over(W.partitionBy("query_id").orderBy(F.desc("n"), F.asc("seen")))
    heads = lines.withColumn("entity_rank", place).where(F.col("entity_rank") <= max_entities)
    return heads.select("query_id", "entity", "entity_rank", "pos", "date", "text")


TRUNCATED = "\n[... truncated to fit the reader context window ...]"


def fit_context(sections: DataFrame, budget: int, keys: tuple[str, ...] = ("context_id",)) -> DataFrame:
    """(keys, pos, content): sections in order while they fit, the first overflow cut and marked.

    ``sections`` has keys, pos and content; blank ones are skipped.  A section takes at least three
    characters with its separator, so only the first budget / 3 of a context can matter.
    """
    kept = sections.where(strip(F.col("content")) != "")
    if budget <= 0:
        return kept.select(*keys, "pos", "content")
    head = top_per_key(kept, list(keys), [F.asc("pos")], budget // 3 + 2, "place")
    items = head.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("place", "pos", "content"))).alias("items")
    )
    grown = lambda acc, x, text: F.concat(acc["out"], F.array(F.struct(x["pos"].alias("pos"), text.alias("content"))))
    pos_type = sections.schema["pos"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<pos:{pos_type},content:string>>")

    def state(used, stop, out):
        return F.struct(used.cast("long").alias("used"), stop.alias("stop"), out.alias("out"))

    def step(acc, x):
        sep = F.when(F.size(acc["out"]) > 0, 2).otherwise(0)
        need = acc["used"] + sep + F.length(x["content"])
        room = (F.lit(budget) - acc["used"] - sep - len(TRUNCATED)).cast("int")
        cut = F.concat(F.substring(x["content"], F.lit(1), F.greatest(room, F.lit(0))), F.lit(TRUNCATED))
        return (
            F.when(acc["stop"], acc)
            .when(need <= budget, state(need, F.lit(False), grown(acc, x, x["content"])))
            .otherwise(state(acc["used"], F.lit(True), F.when(room > 0, grown(acc, x, cut)).otherwise(acc["out"])))
        )

    folded = F.aggregate("items", state(F.lit(0), F.lit(False), empty), step, lambda acc: acc["out"])
    return items.select(*keys, F.inline(folded))


def pack_results(results: DataFrame, header_chars: int, max_chars: int = 4000) -> DataFrame:
    """(query_id, rank, name, content): ranked texts cut to the room left, like a prompt block."""
    items = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "score", "content"))).alias("items")
    )
    note = "\n...(truncated)"
    empty = F.array().cast("array<struct<rank:int,name:string,content:string>>")

    def step(acc, x):
        head = F.length(F.format_string("## %s (relevance: %.3f)\n", x["name"], x["score"]))
        room = (acc["left"] - head - 10).cast("int")
        text = F.when(
            F.length(x["content"]) > room, F.concat(F.substring(x["content"], F.lit(1), F.greatest(room, F.lit(0))), F.lit(note))
        ).otherwise(x["content"])
        row = F.struct(x["rank"].alias("rank"), x["name"].alias("name"), text.alias("content"))
        done = F.struct(acc["left"].alias("left"), F.lit(True).alias("stop"), acc["out"].alias("out"))
        more = F.struct(
            (acc["left"] - head - F.length(text) - 1).cast("long").alias("left"), F.lit(False).alias("stop"),
            F.concat(acc["out"], F.array(row)).alias("out"),
        )
        return F.when(acc["stop"] | (room <= 0), done).otherwise(more)

    start = F.struct(F.lit(max_chars - header_chars).cast("long").alias("left"), F.lit(False).alias("stop"), empty.alias("out"))
    return items.select("query_id", F.inline(F.aggregate("items", start, step, lambda acc: acc["out"])))
