"""Knowledge notes: building, merging, linking, contradictions, triggers, confidence, reflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import fixed
from ..functions import text as T
from ..functions.common import contains_any, overlap, str_array, strip
from ..plans import graph as G
from ..plans.growing import HELD, grown_clusters
from ..plans.ordered import row_index
from ..plans.scale import best_per_key, by_score, top_per_key
from ..plans.simjoin import leaders
from ..session import settle
from .index import unnest
from .scoring import mostly_shared, shared_words
from .search import token_share_search


def make_notes(contents: DataFrame, redact: bool = True, known: list[str] | None = None) -> DataFrame:
    """Notes from (seq, content, source): id, title, keywords, entities, queries written ahead.

    ``seq`` is the order in which the contents came in.
    """
    base = contents.withColumn("content", A.redact_text(F.col("content")) if redact else F.col("content"))
    first = strip(F.substring_index("content", "\n", 1))
    title = F.substring(strip(F.regexp_replace(first, r"^[#\- ]+", "")), 1, 80)
    c = F.col("content")
    rows = base.select(
        "seq", T.note_id(c, F.col("source")).alias("id"), "content", "source", title.alias("title"),
        T.extract_keywords(c).alias("keywords"), T.note_entities(c, known).alias("entities"),
    )
    return rows.withColumn(
        "prospective_queries",
        T.note_queries(c, F.col("title"), F.col("entities"), F.col("keywords")),
    )


def searchable(notes: DataFrame) -> DataFrame:
    """(seq, tokens) over the content and the queries written ahead."""
    text = F.concat_ws(" ", "content", F.array_join("prospective_queries", " "))
    return notes.select("seq", T.note_tokens(text).alias("tokens"))


def merge_duplicates(notes: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(merged notes, assignment) with near duplicates folded into their first note.

    The longest content stays (the earlier of equally long ones), keywords are joined and cut to
    the first 20.  Comparisons use the token set of the first note.
    """
    assigned = settle(leaders(searchable(notes), "seq", "tokens", threshold))
    tagged = notes.join(assigned.select(F.col("id").alias("seq"), "leader", "similarity"), "seq")
    best = best_per_key(
        tagged.select("leader", "seq", "content", "title"), ["leader"], [F.desc(F.length("content")), F.asc("seq")]
    ).select("leader", "content", "title")
    words = top_per_key(
        tagged.select("leader", F.explode("keywords").alias("w")).distinct(), ["leader"], [F.asc("w")], 20
    ).groupBy("leader").agg(F.array_sort(F.collect_list("w")).alias("keywords"))
    count = tagged.groupBy("leader").agg(F.count("*").alias("n_merged"))
    merged = best.join(count, "leader").join(words, "leader", "left").select(
        F.col("leader").alias("seq"), "content", "title",
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "n_merged",
    )
    return merged, assigned


def similar_links(new: DataFrame, existing: DataFrame, k: int = 3, above: float = 0.1) -> DataFrame:
    """(seq, target, similarity, rank): the most similar existing notes of each incoming note.

    Both sides have (seq, tokens).  Shared tokens are counted through the inverted index.
    """
    left = new.select("seq", F.size("tokens").alias("n"), unnest("tokens", "token")).where("token is not null")
    right = existing.repartition("seq").select(
        F.col("seq").alias("target"), F.size("tokens").alias("m"), unnest("tokens", "token")
    ).where("token is not null")
    shared = right.join(left, "token").groupBy("target", "seq").agg(
        F.count("*").alias("common"), F.first("n").alias("n"), F.first("m").alias("m")
    ).where("seq <> target")
    sim = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    scored = shared.select("seq", "target", sim.alias("similarity")).where(F.col("similarity") > above)
    return top_per_key(scored, ["seq"], by_score("target", "similarity"), k)


def entity_pairs(notes: DataFrame) -> DataFrame:
    """(e1, e2, seq): two notes share two entities exactly when they meet on such a pair.

    This is the shared-entity relation in linear size: a pair is a hub its notes hang on.
    """
    e = F.col("entities")
    pairs = F.flatten(
        F.transform(e, lambda a, i: F.transform(F.slice(e, i + 2, F.size(e)), lambda b: F.struct(a.alias("e1"), b.alias("e2"))))
    )
    return notes.select("seq", F.array_sort(F.array_distinct("entities")).alias("entities")).select(
        "seq", F.inline(pairs)
    )


def shared_entity_links(new: DataFrame, existing: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(seq, target, shared): incoming notes and existing notes with two or more common entities."""
    a, b = entity_pairs(new), entity_pairs(existing).withColumnRenamed("seq", "target")
    met = b.join(a, ["e1", "e2"]).where("seq <> target").select("seq", "target").distinct()
    if linked is not None:
        met = met.join(linked.select("seq", "target"), ["seq", "target"], "left_anti")
    full = met.join(new.select("seq", F.col("entities").alias("_a")), "seq").join(
        existing.select(F.col("seq").alias("target"), F.col("entities").alias("_b")), "target"
    )
    return full.select("seq", "target", F.slice(F.array_sort(F.array_intersect("_a", "_b")), 1, 5).alias("shared"))


def _actions(notes: DataFrame) -> DataFrame:
    tokens = T.note_tokens(F.col("content"))
    return notes.select(
        "seq", "entities", tokens.alias("_t"), F.array_sort(T.percentage_tokens(F.col("content"))).alias("pct")
    ).select(
        "seq", "entities", "pct",
        (overlap(F.col("_t"), str_array(fixed.POSITIVE_ACTIONS)) > 0).alias("pos"),
        (overlap(F.col("_t"), str_array(fixed.NEGATIVE_ACTIONS)) > 0).alias("neg"),
    )


def contradictions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(seq, target): the first existing note each incoming note contradicts.

    A contradiction is a shared entity with opposite action words, or two shared entities with
    different percentages.  Only the earliest note per entity and sign, and the two earliest
    distinct percentage sets per entity pair, can be first; nothing is compared pairwise.
    ``existing`` holds the notes that are not superseded and came before ``new``.
    """
    n, e = _actions(new), _actions(existing)
    signs = e.select("seq", "pos", "neg", unnest("entities", "entity")).where("entity is not null")
    first = signs.groupBy("entity").agg(
        F.min(F.when(F.col("pos"), F.col("seq"))).alias("first_pos"),
        F.min(F.when(F.col("neg"), F.col("seq"))).alias("first_neg"),
    )
    acted = n.where("pos or neg").select("seq", "pos", "neg", unnest("entities", "entity")).join(first, "entity")
    opposite = acted.select(
        "seq",
        F.least(
            F.when(F.col("pos"), F.col("first_neg")), F.when(F.col("neg"), F.col("first_pos"))
        ).alias("target"),
    )
    measured = e.where("size(pct) > 0")
    pair_rows = entity_pairs(measured).join(measured.select("seq", F.array_join("pct", "|").alias("pct")), "seq")
    per_set = pair_rows.groupBy("e1", "e2", "pct").agg(F.min("seq").alias("seq"))
    two = top_per_key(per_set, ["e1", "e2"], [F.asc("seq")], 2).select(
        "e1", "e2", F.col("pct").alias("old_pct"), F.col("seq").alias("target")
    )
    mine = n.where("size(pct) > 0")
    asked = entity_pairs(mine).join(mine.select("seq", F.array_join("pct", "|").alias("pct")), "seq")
    different = asked.join(two, ["e1", "e2"]).where("pct <> old_pct").select("seq", "target")
    both = opposite.where("target is not null").unionByName(different)
    return both.groupBy("seq").agg(F.min("target").alias("target"))


def typed_links(links: DataFrame) -> DataFrame:
    """Links (src, dst, type) with their inverse; unknown types are left out."""
    known = links.where(F.col("type").isin(list(fixed.EDGE_INVERSE)))
    inverse = F.create_map(*[F.lit(x) for kv in fixed.EDGE_INVERSE.items() for x in kv])
    back = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"), inverse[F.col("type")].alias("type"))
    return known.select("src", "dst", "type").unionByName(back)


def related(seeds: DataFrame, links: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """(root, node, hops) of the notes around each seed, seeds left out."""
    edges = links if types is None else links.where(F.col("type").isin(types))
    found = G.reachable(seeds.select(F.col("node").alias("root"), "node"), edges, depth)
    return found.where("hops > 0")


def note_search(notes: DataFrame, queries: DataFrame, k: int = 5, keep_superseded: bool = False) -> DataFrame:
    """Notes by the share of query tokens in content and queries written ahead."""
    live = notes
    if not keep_superseded and "superseded_by" in notes.columns:
        live = notes.where(F.coalesce("superseded_by", F.lit("")) == "")
    text = F.concat_ws(" ", "content", F.array_join("prospective_queries", " "))
    return token_share_search(live.select(F.col("seq").alias("item_id"), text.alias("text")), queries, k)


def graph_search(notes: DataFrame, links: DataFrame, queries: DataFrame, k: int = 5, depth: int = 2) -> DataFrame:
    """Search seeds, walk the links, re-rank by token share with seeds x 1.5."""
    seeds = settle(note_search(notes, queries, min(k, 3)).select("query_id", F.col("item_id").alias("node")))
    walk = G.reachable(seeds.select(F.col("query_id").alias("root"), "node"), links, depth)
    reached = walk.select(F.col("root").alias("query_id"), F.col("node").alias("seq"), (F.col("hops") == 0).alias("seed"))
    if "superseded_by" in notes.columns:
        dead = notes.where(F.coalesce("superseded_by", F.lit("")) != "").select("seq")
        reached = reached.where("seed").unionByName(reached.where("not seed").join(dead, "seq", "left_anti"))
    asked = queries.select("query_id", T.note_tokens(F.col("query")).alias("q"))
    # only the notes around the seeds are read as words again
    near = notes.join(reached.select("seq").distinct(), "seq", "left_semi")
    full = reached.join(searchable(near), "seq").join(asked, "query_id")
    share = overlap(F.col("q"), F.col("tokens")) / F.greatest(F.size("q"), F.lit(1))
    scored = full.select("query_id", "seq", "seed", (share * F.when(F.col("seed"), 1.5).otherwise(1.0)).alias("score"))
    return top_per_key(scored, ["query_id"], by_score("seq"), k)


def fired_triggers(triggers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, trigger_id): active triggers with more than half of their condition in the query.

    Shared words are counted where the triggers lie if the words of the queries can be copied to the tasks.
    """
    pairs = queries.select("query_id", F.explode(T.note_tokens(F.col("query"))).alias("token"))
    copied = shared_words(pairs)
    if copied is None:
        return joined_triggers(triggers, queries)
    words = F.coalesce(T.note_tokens(F.col("condition")), F.array().cast("array<string>"))
    return mostly_shared(copied[0], triggers.where("active"), "trigger_id", words, 0.5, queries.schema["query_id"].dataType)


def joined_triggers(triggers: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`fired_triggers` for any number of query words."""
    cond = triggers.where("active").select("trigger_id", T.note_tokens(F.col("condition")).alias("c")).select(
        "trigger_id", F.size("c").alias("n"), unnest("c", "token")
    )
    asked = queries.select("query_id", unnest(T.note_tokens(F.col("query")), "token")).where("token is not null")
    hits = cond.join(asked, "token").groupBy("query_id", "trigger_id").agg((F.count("*") / F.first("n")).alias("share"))
    return hits.where("share > 0.5").select("query_id", "trigger_id")


def _event_map(event: Column) -> Column:
    """Each evidence event as x -> min(hi, max(lo, a x + b))."""
    inf = F.lit(float("inf"))

    def row(a, b, lo, hi):
        return F.struct(
            F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"),
            (-inf if lo is None else F.lit(lo).cast("double")).alias("lo"),
            (inf if hi is None else F.lit(hi).cast("double")).alias("hi"),
        )

    return (
        F.when(event == "confirmed", row(0.9, 0.1, None, 1.0))
        .when(event == "contradicted", row(1.0, -0.15, 0.0, None))
        .when(event == "accessed", row(1.0, 0.02, None, 1.0))
        .when(event == "stale", row(1.0, -0.01, 0.1, None))
        .otherwise(row(1.0, 0.0, None, None))
    )


def _then(f: Column, g: Column) -> Column:
    """g after f; a clamped straight line stays one."""
    clamp = lambda v: F.least(g["hi"], F.greatest(g["lo"], v))
    return F.struct(
        (g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"),
        clamp(g["a"] * f["lo"] + g["b"]).alias("lo"), clamp(g["a"] * f["hi"] + g["b"]).alias("hi"),
    )


def confidence_after(events: DataFrame, start: float = 0.5, chunk: int = 1024) -> DataFrame:
    """(id, confidence, confirmed, contradicted) after replaying (id, seq, event) in order.

    Updates do not commute, but each is a clamped line and such lines compose.  Runs of ``chunk``
    events are composed in parallel, then runs of runs, so a note with very many events is never
    replayed in one task.
    """
    level = row_index(events, ["id"], ["seq"]).select("id", F.col("pos").alias("pos"), _event_map(F.col("event")).alias("f"))
    identity = _event_map(F.lit("none"))
    while True:
        level = settle(
            level.groupBy("id", F.floor((F.col("pos") - 1) / chunk).alias("part")).agg(
                F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("fs")
            ).select("id", (F.col("part") + 1).alias("pos"), F.aggregate("fs", identity, lambda acc, x: _then(acc, x["f"])).alias("f"))
        )
        if level.where("pos > 1").isEmpty():
            break
    f = F.col("f")
    counts = events.groupBy("id").agg(
        F.count_if(F.col("event") == "confirmed").alias("confirmed"),
        F.count_if(F.col("event") == "contradicted").alias("contradicted"),
    )
    value = F.least(f["hi"], F.greatest(f["lo"], f["a"] * start + f["b"]))
    return level.select("id", value.alias("confidence")).join(counts, "id")


# ---- reflection -------------------------------------------------------------------------------


def recent(notes: DataFrame, cutoff: str) -> DataFrame:
    return notes.where((F.col("created") >= cutoff) | (F.col("updated") >= cutoff))


def note_clusters(notes: DataFrame, held: int = HELD) -> DataFrame:
    """(seq, cluster, n): notes join the first cluster in order with two of their keywords and entities.

    A cluster's keys grow with the notes that join it, so later notes may reach it by what earlier ones brought.
    """
    keys = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("keywords", "entities")])
    return grown_clusters(notes.select("seq", keys.alias("keys")), held)


def cluster_summaries(notes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, n, summary): titles of the first five notes, ten entities, start of the first content."""
    tagged = notes.join(clusters, "seq")
    head = top_per_key(tagged.select("cluster", "seq", "title", "content"), ["cluster"], [F.asc("seq")], 5)
    names = top_per_key(
        tagged.select("cluster", F.explode("entities").alias("e")).distinct(), ["cluster"], [F.asc("e")], 10
    ).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("e")), ", ").alias("names"))
    rows = head.groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", F.substring("content", 1, 200).alias("start")))).alias("h")
    )
    full = rows.join(names, "cluster", "left").join(clusters.select("cluster", "n").distinct(), "cluster")
    lines = F.transform("h", lambda x: F.concat(F.lit("- "), x["title"]))
    summary = F.concat_ws(
        "\n", F.format_string("Summary of %d related notes:", F.col("n")),
        F.when(F.col("names") != "", F.concat(F.lit("Entities: "), "names")), F.array_join(lines, "\n"),
        F.concat(F.lit("\nKey content: "), F.col("h")[0]["start"]),
    )
    return full.select("cluster", "n", summary.alias("summary"))


def knowledge_gaps(notes: DataFrame, k: int = 5) -> DataFrame:
    """Entities of decisions without a finding about them, first k in order."""
    low = F.lower("content")
    rows = notes.select(
        contains_any(low, ["decided", "chose", "will"]).alias("d"),
        contains_any(low, ["found", "measured", "scored"]).alias("f"), F.explode("entities").alias("entity"),
    )
    per = rows.groupBy("entity").agg(F.max("d").alias("d"), F.max("f").alias("f"))
    return per.where("d and not f").select("entity").orderBy("entity").limit(k)


def open_contradictions(notes: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return notes.where(~blank("supersedes") & blank("superseded_by"))


# ---- skills -------------------------------------------------------------------------------------


def skill_entries(traces: DataFrame) -> DataFrame:
    """(seq, source, text, tokens): lines with a trigger and an action, in trace and line order.

    ``traces`` has trace_id, name and text.
    """
    line = strip(F.regexp_replace(strip(F.col("line")), r"^[\- ]+", ""))
    low = F.lower("line")
    rule = F.lit(False)
    for trigger, action in fixed.SKILL_MARKERS:
        rule = rule | (low.rlike(trigger) & low.rlike(action))
    rows = traces.select("trace_id", F.col("name").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    rows = rows.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#")).where(rule)
    seq = F.col("trace_id").cast("long") * 65536 + F.col("i")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9_]+"), F.lit(0)))
    return rows.select(seq.alias("seq"), "source", F.substring("line", 1, 200).alias("text"), tokens.alias("tokens"))


def mine_skills(entries: DataFrame) -> DataFrame:
    """Skills from entries grouped around their first similar entry (Jaccard above 0.3).

    (leader, name, description, frequency, n_sources, last_seen).  Of equally common tokens the
    alphabetically first counts; of equally long texts the earliest.
    """
    entries = settle(entries)
    assigned = settle(leaders(entries, "seq", "tokens", 0.3))
    tagged = entries.join(assigned.select(F.col("id").alias("seq"), "leader"), "seq")
    common = tagged.select("leader", F.explode("tokens").alias("t")).groupBy("leader", "t").agg(F.count("*").alias("n"))
    six = top_per_key(common, ["leader"], [F.desc("n"), F.asc("t")], 6)
    kept = six.where(~F.col("t").isin(fixed.SKILL_STOPWORDS) & (F.length("t") > 2)).groupBy("leader").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("key_terms")
    )
    per = tagged.groupBy("leader").agg(
        F.count("*").alias("frequency"), F.max("source").alias("last_seen"),
        F.min(F.struct((-F.length("text")).alias("n"), "seq", "text")).alias("longest"),
    )
    sources = tagged.select("leader", "source").distinct().groupBy("leader").agg(F.count("*").alias("n_sources"))
    full = per.join(sources, "leader").join(kept, "leader", "left")
    terms = F.coalesce("key_terms", F.array().cast("array<string>"))
    name = F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, 4), "-")).otherwise("unnamed")
    return full.select(
        "leader", name.alias("name"), F.col("longest.text").alias("description"), terms.alias("key_terms"),
        "frequency", "n_sources", "last_seen",
    )


def query_skills(skills: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Skills by the share of query tokens among their key terms."""
    asked = queries.select(
        "query_id", F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("q")
    ).select("query_id", F.size("q").alias("n"), unnest("q", "t"))
    hits = skills.select("leader", unnest("key_terms", "t")).join(asked, "t").groupBy("query_id", "leader").agg(
        F.round(F.count("*") / F.first("n"), 3).alias("score")
    )
    return top_per_key(hits, ["query_id"], by_score("leader"), k)
