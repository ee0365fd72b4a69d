"""Trace retrieval: keyword, name and graph scores, catalogue, history, advisories, compiled facts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import answers as A
from ..functions import dates as D
from ..functions import fixed
from ..functions import text as T
from ..functions.code import code_spans
from ..functions.common import contains_any, let, overlap, rule_chain, str_array, strip
from ..plans.scale import best_per_key, by_score, top_per_key
from ..session import settle
from . import localpostings as P
from . import tracescoring as S
from .index import keyword_part, query_terms, tfidf_scores, trace_idf, trace_text, unnest
from .search import entities_in_text


def name_bonus(traces: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, trace_id, bonus): idf share of the query tokens that occur in the trace name.

    Names are searched where they lie (:mod:`.tracescoring`) if the tokens can be copied to the tasks.
    """
    found = S.copied(_asked_tokens(queries))
    if found is None or not found.num_rows:
        return joined_name_bonus(traces, queries)
    ids = pc.unique(S.column(found, "query_id"))
    asked = S.Asked(ids, names=_name_part(traces, found, ids))
    return S.every_score(asked, traces.select("trace_id", "name"), "bonus", queries.schema["query_id"].dataType)


def _asked_tokens(queries: DataFrame) -> DataFrame:
    tokens = queries.select("query_id", F.posexplode(T.trace_tokens(F.col("query"))).alias("i", "term"))
    return tokens.where("query_id is not null").select("query_id", "term")


def _name_part(traces: DataFrame, found: pa.Table, ids: pa.Array) -> S.Names:
    words = pc.unique(S.column(found, "term"))
    n, df = S.frequencies(traces, S.Terms(words), trace_text())
    term, query = (pc.index_in(S.column(found, c), v).to_numpy().astype(np.int64) for c, v in (("term", words), ("query_id", ids)))
    idf = np.where(df > 0, np.log(1 + n / (1 + df)), 1.0)[term]
    return S.Names(S.Labels(words), S.Weights(term, query, idf / np.bincount(query, idf)[query], len(words)))


def joined_name_bonus(traces: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`name_bonus` for any number of query tokens."""
    tokens = queries.select("query_id", F.posexplode(T.trace_tokens(F.col("query"))).alias("i", "term"))
    weighted = tokens.join(trace_idf(traces, tokens.select("term").distinct()), "term", "left").select(
        "query_id", "term", F.coalesce("idf", F.lit(1.0)).alias("idf")
    )
    total = weighted.groupBy("query_id").agg(F.sum("idf").alias("total"))
    terms = weighted.select(F.col("term").alias("id"), F.col("term").alias("label")).distinct()
    named = entities_in_text(traces.select("trace_id", "name"), "trace_id", F.col("name"), terms)
    hit = named.withColumnRenamed("id", "term").join(weighted, "term").groupBy("query_id", "trace_id").agg(
        F.sum("idf").alias("hit")
    )
    return hit.join(total, "query_id").select("query_id", "trace_id", (F.col("hit") / F.col("total")).alias("bonus"))


def _spaced(c: Column) -> Column:
    return F.translate(F.lower(c), "-_", "  ")


def graph_scores(traces: DataFrame, queries: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(query_id, trace_id, graph_score): weight of relations between query and trace-name entities.

    A relation across both sides counts in full, one that touches an entity of both counts half;
    the sum is divided by (largest weight x query entities) and capped at 1.  Names are searched where they lie
    (:mod:`.tracescoring`) if the relations around the queries can be copied to the tasks.
    """
    part = _graph_part(queries, entities, relations)
    if part is None:
        return joined_graph_scores(traces, queries, entities, relations)
    graph, ids = part
    return S.every_score(S.Asked(ids, graph=graph), traces.select("trace_id", "name"), "graph_score", queries.schema["query_id"].dataType)


def _relation_ends(relations: DataFrame) -> DataFrame:
    r = relations.select("source", "target", F.col("weight").cast("double").alias("w"))
    return r.select("source", "target", "w", F.col("source").alias("id"), F.col("target").alias("far")).unionByName(
        r.select("source", "target", "w", F.col("target").alias("id"), F.col("source").alias("far"))
    )


def _graph_part(queries: DataFrame, entities: DataFrame, relations: DataFrame, ids: pa.Array | None = None) -> tuple[S.Graph, pa.Array] | None:
    known = entities.select("id", _spaced(F.col("id")).alias("label"))
    in_q = settle(entities_in_text(queries.select("query_id", _spaced(F.col("query")).alias("q")), "query_id", F.col("q"), known))
    touched = _relation_ends(relations).join(in_q, "id")
    share = lambda end, s: touched.select("query_id", "source", "target", "w", F.col(end).alias("end"), F.lit(s).alias("share"))
    # only what an entity of the relations names is met, as in the joins
    ends = share("far", 1.0).unionByName(share("id", 0.5)).join(known.where("label <> ''").select(F.col("id").alias("end"), "label"), "end").distinct()
    found, asked = S.copied(ends), S.copied(in_q.where("query_id is not null").groupBy("query_id").agg(F.count("*").alias("n")))
    if found is None or asked is None:
        return None
    ids = S.column(asked, "query_id") if ids is None else ids
    code = lambda c, v: pc.index_in(c, v).to_numpy().astype(np.int64)
    labels = pc.unique(S.column(found, "label"))
    relation = pa.StructArray.from_arrays([S.column(found, c) for c in ("source", "target", "w")], names=["source", "target", "w"]).to_pylist()
    places: dict[tuple, int] = {}
    of = np.array([places.setdefault(tuple(r.values()), len(places)) for r in relation], np.int64)
    weight = np.array([w for _, _, w in places])
    known_query = pc.is_in(S.column(found, "query_id"), ids).to_numpy(zero_copy_only=False)
    label, query, halves = code(S.column(found, "label"), labels), pc.fill_null(pc.index_in(S.column(found, "query_id"), ids), 0).to_numpy().astype(np.int64), S.column(found, "share").to_numpy()
    order = np.argsort(label, kind="stable")
    order = order[known_query[order]]
    part = S.Weights(label[order], query[order], halves[order], len(labels))
    top = relations.agg(F.max(F.col("weight").cast("double"))).first()[0] or 0.0
    n = np.ones(len(ids))
    n[code(S.column(asked, "query_id"), ids)] = S.column(asked, "n").to_numpy()
    return S.Graph(S.Labels(labels), part, of[order], weight, np.maximum(n * top, 1.0)), ids


def joined_graph_scores(traces: DataFrame, queries: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """:func:`graph_scores` for any number of relations around the queries."""
    known = entities.select("id", _spaced(F.col("id")).alias("label"))
    in_q = entities_in_text(queries.select("query_id", _spaced(F.col("query")).alias("q")), "query_id", F.col("q"), known)
    in_t = entities_in_text(traces.select("trace_id", _spaced(F.col("name")).alias("n")), "trace_id", F.col("n"), known)
    touched = _relation_ends(relations).join(in_q, "id")
    across = touched.join(in_t.select(F.col("id").alias("far"), "trace_id"), "far").select(
        "query_id", "trace_id", "source", "target", "w", F.lit(1.0).alias("share")
    )
    same = touched.join(in_t, "id").select("query_id", "trace_id", "source", "target", "w", F.lit(0.5).alias("share"))
    per = across.unionByName(same).groupBy("query_id", "trace_id", "source", "target", "w").agg(F.max("share").alias("share"))
    score = per.groupBy("query_id", "trace_id").agg(F.sum(F.col("w") * F.col("share")).alias("s"))
    n = in_q.groupBy("query_id").agg(F.count("*").alias("n"))
    top = relations.agg(F.max(F.col("weight").cast("double"))).scalar()
    return score.join(n, "query_id").select(
        "query_id", "trace_id",
        F.least(F.lit(1.0), F.col("s") / F.greatest(F.col("n") * top, F.lit(1.0))).alias("graph_score"),
    )


def _lexical(traces: DataFrame, queries: DataFrame) -> DataFrame:
    return tfidf_scores(traces, queries).join(name_bonus(traces, queries), ["query_id", "trace_id"], "full_outer")


def retrieve(
    traces: DataFrame, queries: DataFrame, now: Column, k: int = 3,
    entities: DataFrame | None = None, relations: DataFrame | None = None, similarities: DataFrame | None = None,
) -> DataFrame:
    """(query_id, trace_id, score, kw_score, tier, rank) of the best k traces per query.

    0.30 keyword + 0.25 name + 0.10 graph, times the tier weight; vector similarity (0.45) is added
    for the best max(3 k, 8).  Queries whose best score stays below 0.15 are scored again with their
    stems and keep the better score.  ``traces`` has trace_id, name, text and modified.
    """
    if similarities is None and isinstance(traces.schema["trace_id"].dataType, IntegralType):
        best = _retrieve_in_place(traces, queries, now, k, entities, relations)
        if best is not None:
            return best
    w = fixed.TRACE_WEIGHTS
    base = _lexical(traces, queries)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if entities is not None and relations is not None:
        base = base.join(graph_scores(traces, queries, entities, relations), ["query_id", "trace_id"], "full_outer")
    else:
        base = base.withColumn("graph_score", F.lit(0.0))
    tiers = traces.select("trace_id", D.trace_tier(F.col("modified"), now).alias("tier"))
    scored = base.join(tiers, "trace_id").select(
        "query_id", "trace_id", zero("kw_score").alias("kw_score"), zero("graph_score").alias("graph_score"), "tier",
        ((w["keyword"] * zero("kw_score") + w["name"] * zero("bonus") + w["graph"] * zero("graph_score"))
         * D.tier_weight(F.col("tier"))).alias("raw"),
    ).withColumn("score", F.round("raw", 4))
    if similarities is not None:
        head = top_per_key(scored, ["query_id"], by_score("trace_id"), max(3 * k, 8), "_r").drop("_r")
        lifted = head.join(similarities, ["query_id", "trace_id"], "left").withColumn(
            "score", F.round(F.col("raw") + w["embedding"] * zero("similarity") * D.tier_weight(F.col("tier")), 4)
        ).drop("similarity")
        scored = scored.join(head.select("query_id", "trace_id"), ["query_id", "trace_id"], "left_anti").unionByName(lifted)
    # the first pass is read again for the weak queries and for the final ranking
    scored = settle(scored)
    best = queries.select("query_id", "query").join(
        scored.groupBy("query_id").agg(F.max("score").alias("best")), "query_id"
    )
    weak = best.where("best < 0.15").select("query_id", T.expand_query(F.col("query")).alias("query"))
    again = _lexical(traces, weak).join(tiers, "trace_id").select(
        "query_id", "trace_id",
        F.round((w["keyword"] * zero("kw_score") + w["name"] * zero("bonus")) * D.tier_weight(F.col("tier")), 4).alias("second"),
    )
    final = scored.drop("raw").join(again, ["query_id", "trace_id"], "left").withColumn(
        "score", F.greatest("score", F.coalesce("second", F.lit(0.0)))
    ).drop("second")
    return top_per_key(final, ["query_id"], by_score("trace_id"), k)


def _lexical_parts(traces: DataFrame, queries: DataFrame, ids: pa.Array) -> tuple[S.Keywords, S.Names] | None:
    terms, tokens = S.copied(query_terms(queries)), S.copied(_asked_tokens(queries))
    if terms is None or tokens is None:
        return None
    return keyword_part(traces, terms, ids), _name_part(traces, tokens, ids)


def _retrieve_in_place(
    traces: DataFrame, queries: DataFrame, now: Column, k: int, entities: DataFrame | None, relations: DataFrame | None
) -> DataFrame | None:
    """:func:`retrieve` without similarities: all scores of a trace are added up where it lies, the best are cut in each task."""
    held = S.copied(queries.where("query_id is not null").select("query_id").distinct())
    if held is None or not held.num_rows:
        return None
    ids, graph = S.column(held, "query_id"), None
    lexical = _lexical_parts(traces, queries, ids)
    if entities is not None and relations is not None:
        graph = _graph_part(queries, entities, relations, ids)
    if lexical is None or (entities is not None and relations is not None and graph is None):
        return None
    key, tier = queries.schema["query_id"].dataType, D.trace_tier(F.col("modified"), now)
    asked = S.Asked(ids, *lexical, graph and graph[0])
    order = by_score("trace_id")
    first = settle(top_per_key(S.best_traces(asked, traces, tier, D.tier_weight(tier), k, key), ["query_id"], order, k))
    weak = settle(first.groupBy("query_id").agg(F.max("score").alias("best")).where("best < 0.15").select("query_id"))
    stems = queries.join(weak, "query_id", "left_semi").select("query_id", T.expand_query(F.col("query")).alias("query"))
    again = _lexical_parts(traces, stems, ids) if not weak.isEmpty() else None
    if again is None:
        return first
    second = S.best_traces(asked, traces, tier, D.tier_weight(tier), k, key, S.Asked(ids, *again)).join(weak, "query_id", "left_semi")
    return first.join(weak, "query_id", "left_anti").unionByName(top_per_key(second, ["query_id"], order, k))


def best_paragraph_similarity(paragraph_vectors: DataFrame, query_vectors: DataFrame, per_trace: int = 10) -> DataFrame:
    """(query_id, trace_id, similarity): best cosine over the first ten paragraphs of a trace.

    ``paragraph_vectors`` has trace_id, para_idx, embedding.
    """
    from .vectorindex import similar_above

    first = top_per_key(paragraph_vectors, ["trace_id"], [F.asc("para_idx")], per_trace)
    sims = similar_above(
        first.select(F.struct("trace_id", "para_idx").alias("k"), "embedding").select(
            F.to_json("k").alias("vec_id"), "embedding"
        ), query_vectors, -2.0,
    )
    tid = first.schema["trace_id"].dataType.simpleString()
    return sims.select("query_id", F.get_json_object("vec_id", "$.trace_id").cast(tid).alias("trace_id"), "similarity").groupBy(
        "query_id", "trace_id"
    ).agg(F.max("similarity").alias("similarity"))


def related_traces(traces: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """(trace_id, other, similarity, shared_terms, rank): most similar traces by token Jaccard.

    ``asked`` holds the trace_ids to find neighbours for.  Tokens of name and text.
    """
    stem = F.regexp_replace("name", r"\.md$", "")
    tokens = F.array_distinct(T.trace_tokens(F.concat_ws(" ", "text", F.translate(stem, "-_", "  "))))
    sets = traces.repartition("trace_id").select("trace_id", tokens.alias("t")).select("trace_id", F.size("t").alias("n"), "t")
    held = sets.select(F.col("trace_id").alias("other"), F.col("n").alias("m"), unnest("t", "token")).where("token is not null")
    want = sets.join(asked.select("trace_id"), "trace_id", "left_semi").select("trace_id", "n", unnest("t", "token"))
    shared = held.join(want.where("token is not null"), "token").groupBy("other", "trace_id").agg(
        F.count("*").alias("shared_terms"), F.first("n").alias("n"), F.first("m").alias("m")
    ).where("other <> trace_id")
    sim = F.round(F.col("shared_terms") / (F.col("n") + F.col("m") - F.col("shared_terms")), 4)
    return top_per_key(
        shared.select("trace_id", "other", "shared_terms", sim.alias("similarity")), ["trace_id"], by_score("other", "similarity"), k
    )


def suggest_queries(history: DataFrame, prefix: str, k: int = 8) -> DataFrame:
    """Newest distinct past queries with a prefix of two or more characters; (pos, query) history."""
    rows = history.where(F.lit(len(prefix) >= 2) & F.lower("query").startswith(prefix.lower()))
    return rows.groupBy("query").agg(F.max("pos").alias("pos")).orderBy(F.desc("pos")).limit(k)


def trace_summary(text: Column) -> Column:
    """First content line after the first heading."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n", -1), strip)

    def pick(ls):
        at = F.get(F.filter(F.transform(ls, lambda s, i: F.when(s.startswith("#"), i)), lambda i: i.isNotNull()), F.lit(0))
        content = F.filter(
            F.transform(ls, lambda s, i: F.when(i > at, s)),
            lambda s: s.isNotNull() & (s != "") & ~s.startswith("#") & ~s.startswith("---")
            & ~((s.startswith("**") | s.startswith("- **")) & s.contains(":**")),
        )
        first = strip(F.regexp_replace(F.get(content, F.lit(0)), r"^[\- ]+", ""))
        return F.coalesce(F.nullif(first, F.lit("")), F.lit("(no summary)"))

    return let(lines, pick)


def chunk_catalog(traces: DataFrame) -> DataFrame:
    """(project, date, n, summary) of traces grouped by the fields of their file name."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    parts = F.split(stem, "_", 3)
    rows = traces.select(
        F.substring_index(parts[0], "T", 1).alias("date"), F.coalesce(F.get(parts, F.lit(1)), F.lit("general")).alias("project")
    )
    n = F.col("n")
    per = rows.groupBy("project", "date").agg(F.count("*").alias("n"))
    return per.select(
        "project", "date", "n",
        F.format_string("%s: %d trace%s (%s)", F.col("project"), n, F.when(n > 1, "s").otherwise(""), F.col("date")).alias("summary"),
    )


def evaluate(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (queries, precision_at_1, mrr); ``truth`` has query_id and an expected name part."""
    hits = results.join(truth, "query_id").where(F.col("name").contains(F.col("expected"))).groupBy("query_id").agg(
        F.min("rank").alias("rank")
    )
    full = truth.select("query_id").join(hits, "query_id", "left")
    return full.agg(
        F.count("*").alias("queries"), F.avg(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))).alias("precision_at_1"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def advisories(texts: DataFrame, limit: int = 3) -> DataFrame:
    """(text_id, query_id, query): the first decision points of each text as queries."""
    points = F.slice(A.decision_points(F.col("text")), 1, limit)
    return texts.select("text_id", F.posexplode(points).alias("i", "query")).select(
        "text_id", F.concat_ws("-", F.col("text_id").cast("string"), F.col("i").cast("string")).alias("query_id"), "query"
    )


def guard_warnings(results: DataFrame, actions: DataFrame) -> DataFrame:
    """(query_id, name, sentence): sentences of strong results that speak against an action.

    ``results`` has query_id, name, score and text; ``actions`` query_id and action.  A sentence
    counts with a warning word and two words of the action.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != ""))
    full = results.where("score >= 0.3").join(actions, "query_id")
    rows = full.select(
        "query_id", "name", words(F.lower("action")).alias("a"), F.explode(F.split(F.lower("text"), r"\.", -1)).alias("s")
    )
    hit = contains_any(F.col("s"), fixed.GUARD_WORDS) & (overlap(F.col("a"), words(F.col("s"))) >= 2)
    return rows.where(hit).select("query_id", "name", F.substring(strip(F.col("s")), 1, 120).alias("sentence"))


# ---- compiled facts ----------------------------------------------------------------------------------


def _terms(c: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_except(F.filter(tokens, lambda t: F.length(t) > 2), str_array(fixed.COMPILED_STOPWORDS))


def compiled_intent(low: Column) -> Column:
    rules = []
    for name, cues in fixed.COMPILED_INTENTS:
        cond = F.lit(False)
        for cue in cues:
            cond = cond | (low.startswith(cue[1:]) if cue.startswith("^") else low.contains(cue))
        rules.append((name, cond))
    return rule_chain(rules, "factual")


def search_compiled(facts: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, fact_id, score, priority, rank) of compiled facts.

    A fact needs two common terms, an alias or its subject in the query.  Term hits come from the
    inverted index, alias and subject hits from the label index.
    """
    q = F.col("query")
    low = F.lower(q)
    truth = rule_chain([(n, contains_any(low, ws)) for n, ws in fixed.TRUTH_MODES], "current")
    asked = queries.select("query_id", "query", compiled_intent(low).alias("q_type"), truth.alias("q_truth")).where(F.size(_terms(q)) > 0)
    hay = F.concat_ws(" ", "subject", "fact", F.array_join("aliases", " "))
    held = facts.select("fact_id", unnest(_terms(hay), "t")).where("t is not null")
    want = asked.select("query_id", unnest(_terms(q), "t"))
    common = held.join(want, "t").groupBy("query_id", "fact_id").agg(F.count("*").alias("n"))
    labels = facts.select("fact_id", F.explode(F.filter("aliases", lambda a: a != "")).alias("label"), F.lit("alias").alias("kind")).unionByName(
        facts.select("fact_id", F.col("subject").alias("label"), F.lit("subject").alias("kind"))
    ).withColumn("id", F.lower("label"))
    named = entities_in_text(asked.select("query_id", "query"), "query_id", q, labels.select("id", F.col("id").alias("label")).distinct())
    exact = named.join(labels.select("id", "fact_id", "kind"), "id").groupBy("query_id", "fact_id").agg(
        F.bool_or(F.col("kind") == "alias").alias("alias"), F.bool_or(F.col("kind") == "subject").alias("subject_hit")
    )
    rows = common.join(exact, ["query_id", "fact_id"], "full_outer").select(
        "query_id", "fact_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("alias", F.lit(False)).alias("alias"),
        F.coalesce("subject_hit", F.lit(False)).alias("subject_hit"),
    ).where("n >= 2 or alias or subject_hit")
    full = rows.join(asked.drop("query"), "query_id").join(
        facts.select("fact_id", "fact_type", "truth_mode", "priority"), "fact_id"
    )
    mode = (
        F.when(F.col("truth_mode") == F.col("q_truth"), 3.0)
        .when((F.col("q_truth") == "current") & F.col("truth_mode").isin("historical", "benchmark_expected"), -6.0)
        .otherwise(0.0)
    )
    score = (
        F.col("n") * 1.5 + F.col("priority") + F.when(F.col("fact_type") == F.col("q_type"), 3.0).otherwise(0.0) + mode
        + F.when(F.col("subject_hit"), 2.0).otherwise(0.0) + F.when(F.col("alias"), 4.0).otherwise(0.0)
    )
    kept = full.select("query_id", "fact_id", "priority", score.alias("score")).where("score >= 1.0")
    return top_per_key(kept, ["query_id"], [F.desc(F.round("score", 9)), F.desc("priority"), F.asc("fact_id")], k)


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """Highest priority per fact_id, the first one on a tie; ``pos`` is the order of arrival."""
    return best_per_key(facts, ["fact_id"], [F.desc("priority"), F.asc("pos")])


def compiled_results(matches: DataFrame, facts: DataFrame, least: float = 8.0) -> DataFrame:
    """Compiled facts as priority search results with 1000 added to their score."""
    return matches.where(F.col("score") >= least).join(facts.select("fact_id", "fact"), "fact_id").select(
        "query_id", "rank", F.concat("fact_id", F.lit(".fact")).alias("name"), F.lit("compiled").alias("source"),
        F.round(F.col("score") + 1000.0, 4).alias("score"), F.substring("fact", 1, 300).alias("snippet"),
        F.col("fact").alias("answer"), F.lit(1.0).alias("confidence"),
    )


def index_facts(documents: DataFrame, paragraphs: DataFrame, built: Column, source: str) -> DataFrame:
    """The size and the time of an index as two compiled facts; ``built`` is the time as text."""
    tokens = paragraphs.select(F.lower("text").alias("_text")).mapInArrow(P.words, "t string").distinct()
    count = F.count("*")
    n = documents.agg(count.alias("d")).withColumns({"p": paragraphs.agg(count).scalar(), "u": tokens.agg(count).scalar()})
    comma = lambda c: F.format_number(c, 0)
    size = F.concat(
        F.lit("The current unified memory index contains "), comma("d"), F.lit(" documents, "), comma("p"), F.lit(" paragraphs, and "), comma("u"), F.lit(" unique tokens."),
    )
    row = lambda name, kind, subject, fact, weight, aliases: F.struct(
        F.lit(name).alias("fact_id"), F.lit(kind).alias("fact_type"), F.lit(subject).alias("subject"), fact.alias("fact"),
        F.lit(source).alias("source"), built.alias("valid_from"), F.lit(weight).alias("priority"), str_array(aliases).alias("aliases"),
    )
    made = F.concat(F.lit("The current unified memory index file was written at "), built, F.lit("."))
    return n.select(F.inline(F.array(
        row("index.current_size", "metric", "Unified memory index size", size, 4.0, fixed.INDEX_SIZE_ALIASES),
        row("index.current_timestamp", "temporal", "Unified memory index build timestamp", made, 3.5, fixed.INDEX_TIME_ALIASES),
    )))


def symbol_facts(files: DataFrame, shown: int = 20) -> DataFrame:
    """One compiled fact per module that defines something at its top level, from (path, code).

    The fact names the first ``shown`` symbols, as the sentence is for reading; ``symbols`` holds them all.  Test modules are
    left out.
    """
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "")
    top = F.transform(F.filter(code_spans("code"), lambda s: s["owner"].isNull()), lambda s: s["name"])
    rows = files.select("path", stem.alias("stem"), top.alias("symbols")).where("symbols is not null and size(symbols) > 0 and stem not like 'test\\_%'")
    fact = F.concat(
        F.lit("The "), "stem", F.lit(" module is at "), "path", F.lit(". Top-level symbols include "), F.array_join(F.slice("symbols", 1, shown), ", "), F.lit("."),
    )
    return rows.select(
        F.concat(F.lit("symbols."), "stem").alias("fact_id"), F.lit("location").alias("fact_type"), F.concat("stem", F.lit(" symbols")).alias("subject"),
        fact.alias("fact"), F.col("path").alias("source"), F.lit(2.0).alias("priority"),
        F.array(F.concat(F.lit("where are the "), F.translate("stem", "_", " "), F.lit(" functions"))).alias("aliases"), "symbols",
    )


def compile_facts(*sources: DataFrame) -> DataFrame:
    """Join fact tables in order and keep the best of each id."""
    merged = None
    for i, s in enumerate(sources):
        one = s.withColumn("pos", F.lit(i))
        merged = one if merged is None else merged.unionByName(one, allowMissingColumns=True)
    return dedupe_facts(merged).drop("pos")


