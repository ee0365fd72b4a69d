"""Queries for trace retrieval, compiled facts and the vector index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import vectors as V
from ..operators import traces as R
from ..operators import vectorindex as X
from ..operators.consolidate import relation_table
from ..session import settle
from .base import MEMO_SQL, derive, memo, query, table
from .note_queries import PAIRS_SQL, memo_pairs
from .search_queries import nation_questions
from .text_queries import _TRACE_TOKENS, STRIP, words_sql


def memo_traces(spark, folder):
    m = memo(spark, folder)
    return m.select(F.col("event_id").alias("trace_id"), "name", F.col("body").alias("text"), F.col("ts").alias("modified"))


_TIER = "case when epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts) <= 86400000000 then 'hot' when epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts) <= 604800000000 then 'warm' else 'cold' end"


@query(f"select {_TIER} as tier, count(*) as n, case {_TIER} when 'hot' then 1.02 when 'warm' then 1.0 else 0.98 end::double as weight from events group by 1, 3")
def trace_tiers(spark, folder):
    from ..functions import dates as D

    tier = D.trace_tier(F.col("ts"), F.lit("2024-01-31").cast("timestamp"))
    e = table(spark, folder, "events").select(tier.alias("tier"))
    return e.groupBy("tier").agg(F.count("*").alias("n")).withColumn("weight", D.tier_weight(F.col("tier")))


@query(
    f"""with q as (select cast(n_nationkey as bigint) as query_id, list_filter(string_split_regex(lower('alder cedar decision 2024 zzz nation ' || n_name), '[^a-z0-9_]+'), lambda w: length(w) > 1) as q from nation),
    d as (select event_id as trace_id, lower(name) as name, {_TRACE_TOKENS.format("body || ' ' || translate(name, '-_', '  ')")} as j from {MEMO_SQL}),
    df as (select t, count(*) as df from (select distinct trace_id, unnest(j) as t from d) group by 1),
    w as (select query_id, t, coalesce(ln(1 + (select count(*) from d) / (1 + df)), 1.0) as idf from (select query_id, unnest(q) as t from q) left join df using (t)),
    s as (select query_id, sum(idf) as total from w group by 1),
    h as (select query_id, trace_id, sum(idf) as hit from w join d on contains(d.name, t) group by 1, 2)
    select query_id, trace_id, round(hit / total, 9) as bonus from h join s using (query_id)"""
)
def name_bonus(spark, folder):
    asked = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("alder cedar decision 2024 zzz nation "), "n_name").alias("query")
    )
    return R.name_bonus(memo_traces(spark, folder), asked).select("query_id", "trace_id", F.round("bonus", 9).alias("bonus"))


_GRAPH_NAME = "concat(project, '-v2.', n % 7, '_', city, '_bm25-', event_id % 50, '.md')"


def named_traces(spark, folder):
    return memo(spark, folder).select(F.col("event_id").alias("trace_id"), F.expr(_GRAPH_NAME).alias("name"), "text", F.col("ts").alias("modified"))


_GRAPH_ASK = "concat('how is v1.', n_nationkey % 5, ' related to the gpu and the daemon')"


@query(
    f"""with {PAIRS_SQL}, ids as (select source as id from rel union select target from rel),
    q as (select cast(n_nationkey as bigint) as query_id, translate(lower({_GRAPH_ASK}), '-_', '  ') as q from nation),
    t as (select event_id as trace_id, translate(lower({_GRAPH_NAME}), '-_', '  ') as n from {MEMO_SQL}),
    qe as (select query_id, id from q join ids on contains(q, translate(lower(id), '-_', '  '))), te as (select trace_id, id from t join ids on contains(n, translate(lower(id), '-_', '  '))),
    x as (select qe.query_id, te.trace_id, source, target, weight, 1.0 as share from rel join qe on qe.id = source join te on te.id = target
      union all select qe.query_id, te.trace_id, source, target, weight, 1.0 from rel join qe on qe.id = target join te on te.id = source
      union all select qe.query_id, te.trace_id, source, target, weight, 0.5 from rel join qe on qe.id = source join te on te.id = source
      union all select qe.query_id, te.trace_id, source, target, weight, 0.5 from rel join qe on qe.id = target join te on te.id = target),
    p as (select query_id, trace_id, source, target, weight, max(share) as share from x group by all),
    c as (select query_id, count(*) as n from qe group by 1)
    select query_id, trace_id, round(least(1.0, sum(weight * share) / greatest(any_value(n) * (select max(weight) from rel), 1.0)), 9) as graph_score from p join c using (query_id) group by 1, 2"""
)
def trace_graph_scores(spark, folder):
    rel = settle(relation_table(memo_pairs(spark, folder)))
    ents = rel.select(F.col("source").alias("id")).unionByName(rel.select(F.col("target").alias("id"))).distinct()
    asked = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.expr(_GRAPH_ASK).alias("query"))
    out = R.graph_scores(named_traces(spark, folder), asked, ents, rel)
    return out.select("query_id", "trace_id", F.round("graph_score", 9).alias("graph_score"))


@query()
def trace_retrieval(spark, folder):
    """Keyword, name and graph scores with tiers and stem expansion."""
    rel = settle(relation_table(memo_pairs(spark, folder)))
    ents = rel.select(F.col("source").alias("id")).unionByName(rel.select(F.col("target").alias("id"))).distinct()
    found = R.retrieve(
        named_traces(spark, folder), nation_questions(spark, folder), F.lit("2024-01-31").cast("timestamp"), 3, ents, rel
    )
    return found.select("query_id", "trace_id", "score", F.round("kw_score", 6).alias("kw_score"), "tier", "rank")


@query(
    f"""with t as (select doc_id, list_distinct({_TRACE_TOKENS.format("text || ' ' || 'note ' || lang")}) as t from documents),
    a as (select t.* from t join benchmark on item_id = doc_id),
    j as (select a.doc_id as trace_id, t.doc_id as other, len(list_intersect(a.t, t.t)) as c, len(a.t) as n, len(t.t) as m from a, t where a.doc_id <> t.doc_id),
    s as (select trace_id, other, c as shared_terms, round(c / (n + m - c), 4) as similarity from j where c > 0)
    select *, row_number() over (partition by trace_id order by similarity desc, other) as rank from s qualify rank <= 3"""
)
def related_traces(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("trace_id"), F.concat(F.lit("note-"), "lang", F.lit(".md")).alias("name"), "text")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("trace_id"))
    return R.related_traces(d, asked, 3).select("trace_id", "other", "shared_terms", "similarity", "rank")


@query(
    f"""with h as (select event_id as pos, question as query from {MEMO_SQL}) select query, max(pos) as pos from h where lower(query) like 'when did a%' group by 1 order by pos desc limit 8"""
)
def suggest_queries(spark, folder):
    history = memo(spark, folder).select(F.col("event_id").alias("pos"), F.col("question").alias("query"))
    return R.suggest_queries(history, "When did A", 8)


@query(
    rf"""with l as (select event_id, {STRIP.format('x')} as s, i from (select event_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from {MEMO_SQL}))
    select event_id, regexp_replace(arg_min(s, i), '^[- ]+', '') as summary from l where i > 1 and s <> '' and s not like '#%' group by 1"""
)
def trace_summaries(spark, folder):
    return memo(spark, folder).select("event_id", R.trace_summary(F.col("text")).alias("summary"))


@query(
    f"""select project, day as date, count(*) as n, project || ': ' || count(*) || ' trace' || case when count(*) > 1 then 's' else '' end || ' (' || day || ')' as summary from {MEMO_SQL} group by 1, 2"""
)
def chunk_catalog(spark, folder):
    return R.chunk_catalog(memo(spark, folder).select("name"))


@query(
    f"""with r as (select event_id as query_id, 1 + event_id % 4 as rank, name from {MEMO_SQL}), t as (select event_id as query_id, case when event_id % 3 = 0 then 'alder' else project end as expected from {MEMO_SQL}),
    h as (select query_id, min(rank) as rank from r join t using (query_id) where contains(name, expected) group by 1)
    select count(*) as queries, round(avg(case when rank = 1 then 1 else 0 end), 9) as precision_at_1, round(avg(coalesce(1.0 / rank, 0)), 9) as mrr from t left join h using (query_id)"""
)
def ranking_evaluation(spark, folder):
    m = memo(spark, folder)
    results = m.select(F.col("event_id").alias("query_id"), F.expr("1 + event_id % 4").alias("rank"), "name")
    truth = m.select(F.col("event_id").alias("query_id"), F.expr("case when event_id % 3 = 0 then 'alder' else project end").alias("expected"))
    out = R.evaluate(results, truth)
    return out.select("queries", F.round("precision_at_1", 9).alias("precision_at_1"), F.round("mrr", 9).alias("mrr"))


@query(
    rf"""with s as (select event_id, {STRIP.format('x')} as s, i from (select event_id, unnest(string_split_regex(text, '[.!?\n]')) as x, generate_subscripts(string_split_regex(text, '[.!?\n]'), 1) as i from {MEMO_SQL})),
    d as (select *, row_number() over (partition by event_id order by i) - 1 as n from s where length(s) >= 15 and regexp_matches(s, '(?i){"|".join(fixed.DECISION_POINTS)}'))
    select event_id as text_id, event_id || '-' || n as query_id, s as query from d where n < 3"""
)
def advisory_queries(spark, folder):
    return R.advisories(memo(spark, folder).select(F.col("event_id").alias("text_id"), "text"))


@query(
    rf"""with r as (select event_id as query_id, name, value / 20 as score, lower(body) as t, list_distinct(list_filter(string_split('reuse the parser for ' || lower(who), ' '), lambda w: w <> '')) as a from {MEMO_SQL}),
    s as (select query_id, name, a, unnest(string_split(t, '.')) as s from r where score >= 0.3)
    select query_id, name, substr({STRIP.format('s')}, 1, 120) as sentence from s where {words_sql('s', [w.replace("'", "''") for w in fixed.GUARD_WORDS])}
      and len(list_intersect(a, list_distinct(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')))) >= 2"""
)
def guard_warnings(spark, folder):
    m = memo(spark, folder)
    results = m.select(F.col("event_id").alias("query_id"), "name", (F.col("value") / 20).alias("score"), F.col("body").alias("text"))
    actions = m.select(F.col("event_id").alias("query_id"), F.concat(F.lit("reuse the parser for "), F.lower("who")).alias("action"))
    return R.guard_warnings(results, actions)


# ---- compiled facts -----------------------------------------------------------------------------------

_FACT = {
    "fact_id": "concat('part.', p_partkey % 500)", "pos": "p_partkey", "fact_type": "split_part('metric,location,decision,factual', ',', cast(1 + p_partkey % 4 as int))",
    "subject": "p_name", "fact": "concat(p_name, ' of ', p_brand, ' is ', p_type, ' with size ', p_size)", "truth_mode": "split_part('current,historical,benchmark_expected', ',', cast(1 + p_partkey % 3 as int))",
    "priority": "cast(p_size % 10 as double)", "brand": "p_brand",
}
_FACT_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in _FACT.items()) + " from part"


def part_facts(spark, folder):
    f = table(spark, folder, "part").selectExpr(*[f"{e} as {c}" for c, e in _FACT.items()])
    return f.withColumn("aliases", F.array("brand")).drop("brand")


_DEDUPED = f"d as (select * from ({_FACT_SQL}) qualify row_number() over (partition by fact_id order by priority desc, pos) = 1)"


@query(f"with {_DEDUPED} select fact_id, priority, pos from d")
def compiled_dedupe(spark, folder):
    return R.dedupe_facts(part_facts(spark, folder)).select("fact_id", "priority", "pos")


_CASK = "concat('how many of the ', split_part(p_name, ' ', 1), ' ', split_part(p_type, ' ', 1), ' parts of ', p_brand, ' with size ', p_size % 7)"
_CT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda t: length(t) > 2 and t not in (" + ",".join(f"'{w}'" for w in fixed.COMPILED_STOPWORDS) + ")))"


@query(
    f"""with {_DEDUPED}, q as (select distinct p_size as query_id, first_value(lower({_CASK})) over (partition by p_size order by p_partkey) as q from part),
    j as (select query_id, fact_id, priority, fact_type, truth_mode, len(list_intersect({_CT.format('q')}, {_CT.format("subject || ' ' || fact || ' ' || brand")})) as n, contains(q, lower(brand)) as alias, contains(q, lower(subject)) as subj from q, d),
    s as (select query_id, fact_id, priority, n * 1.5 + priority + case when fact_type = 'metric' then 3 else 0 end + case when truth_mode = 'current' then 3 else -6 end + case when subj then 2 else 0 end + case when alias then 4 else 0 end as score
      from j where n >= 2 or alias or subj)
    select query_id, fact_id, round(score, 9) as score, row_number() over (partition by query_id order by score desc, priority desc, fact_id) as rank from s where score >= 1 qualify rank <= 5"""
)
def compiled_search(spark, folder):
    from ..plans.scale import best_per_key

    p = table(spark, folder, "part")
    asked = best_per_key(p, ["p_size"], [F.asc("p_partkey")]).select(F.col("p_size").alias("query_id"), F.expr(f"lower({_CASK})").alias("query"))
    found = R.search_compiled(R.dedupe_facts(part_facts(spark, folder)), asked, 5)
    return found.select("query_id", "fact_id", F.round("score", 9).alias("score"), "rank")


@query()
def priority_merge(spark, folder):
    """Compiled facts in front of ordinary results, without repeats."""
    from ..operators.search import merge_priority, token_share_search
    from ..plans.scale import best_per_key

    p = table(spark, folder, "part")
    asked = best_per_key(p, ["p_size"], [F.asc("p_partkey")]).select(F.col("p_size").alias("query_id"), F.expr(f"lower({_CASK})").alias("query"))
    facts = R.dedupe_facts(part_facts(spark, folder))
    first = R.compiled_results(R.search_compiled(facts, asked, 5), facts)
    items = p.select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    rest = token_share_search(items, asked, 5).join(items, "item_id").select(
        "query_id", "rank", F.col("item_id").cast("string").alias("name"), F.lit("part").alias("source"), "score",
        F.col("text").alias("snippet"), F.lit("").alias("answer"), F.lit(0.5).alias("confidence"),
    )
    return merge_priority(first, rest, 5).select("query_id", "rank", "name", "source", F.round("score", 4).alias("score"))


#: facts written down by hand; one per nation contests the fact of a module
_SEED = {
    "fact_id": "concat('symbols.part_', n_nationkey + 1)", "fact_type": "'location'", "subject": "n_name", "fact": "concat('Part ', n_nationkey + 1, ' is known to ', n_name, '.')",
    "source": "'seed.jsonl'", "priority": "cast(1 + n_nationkey % 3 as double)", "aliases": "array(n_name)",
}


@query(
    f"""with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_]{{2,}}')) as t from documents),
    i as (select 'index.current_size' as fact_id, format('The current unified memory index contains {{:,}} documents, {{:,}} paragraphs, and {{:,}} unique tokens.', (select count(*) from documents), (select count(*) from documents), (select count(*) from t)) as fact, 4.0::double as priority, 0 as pos
      union all select 'index.current_timestamp', 'The current unified memory index file was written at 2024-01-31T00:00:00Z.', 3.5, 0),
    s as (select 'symbols.part_' || p_partkey as fact_id, 'The part_' || p_partkey || ' module is at src/part_' || p_partkey || '.py. Top-level symbols include ' ||
      case when p_partkey % 3 = 0 then 'Part' || p_partkey || ', Part' || p_partkey else 'price_' || p_partkey || ', Part' || p_partkey end || '.' as fact, 2.0::double as priority, 1 as pos from part),
    n as (select 'symbols.part_' || (n_nationkey + 1), 'Part ' || (n_nationkey + 1) || ' is known to ' || n_name || '.', (1 + n_nationkey % 3)::double, 2 from nation)
    select fact_id, fact, priority from (select *, row_number() over (partition by fact_id order by priority desc, pos) as r from (select * from i union all select * from s union all select * from n)) where r = 1"""
)
def compiled_facts(spark, folder):
    """Facts about the index, about modules and written by hand, the strongest of each id."""
    from .text_queries import _CODE

    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = R.index_facts(docs, docs, F.lit("2024-01-31T00:00:00Z"), "index")
    files = table(spark, folder, "part").select(F.concat(F.lit("src/part_"), "p_partkey", F.lit(".py")).alias("path"), F.expr(_CODE).alias("code"))
    seed = derive(table(spark, folder, "nation"), _SEED)
    return R.compile_facts(index, R.symbol_facts(files), seed).select("fact_id", "fact", "priority")


# ---- vectors -----------------------------------------------------------------------------------------------

_UNIT = "list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))"


@query(
    f"""with v as (select vec_id, label, {_UNIT} as e from embeddings), q as (select item_id as query_id, e from benchmark join v on vec_id = item_id),
    s as (select query_id, vec_id, list_dot_product(q.e, v.e) as sim from q, v)
    select query_id, vec_id, round(sim, 6) as similarity, row_number() over (partition by query_id order by round(sim, 9) desc, vec_id) as rank from s qualify rank <= 5"""
)
def cosine_topk(spark, folder):
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    ids = table(spark, folder, "benchmark").select(F.col("item_id").alias("vec_id"))
    probes = v.join(ids, "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    return X.cosine_topk(v, probes, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    """with p as (select vec_id, label, unnest(list_transform(embedding, lambda x: x::double)) as x, generate_subscripts(embedding, 1) as d from embeddings),
    m as (select label, d, avg(x) as m from p group by 1, 2),
    s as (select vec_id, label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) as c from p join m using (label, d) group by 1, 2)
    select label, count(*) as n, round(avg(c), 8) as mean_cosine, round(min(c), 8) as min_cosine from s group by 1"""
)
def cosine_by_label(spark, folder):
    """Cosine of every vector to the mean of its label."""
    e = table(spark, folder, "embeddings")
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("m"))
    c = e.join(mean, "label").select("label", V.cosine(F.col("embedding"), F.col("m")).alias("c"))
    return c.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("c"), 8).alias("mean_cosine"), F.round(F.min("c"), 8).alias("min_cosine"))


@query(
    """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    s as (select vec_id, e, list_max(list_transform(e, lambda x: abs(x))) as s from v),
    c as (select vec_id, e, s, list_transform(e, lambda x: trunc(x / s * 127)) as c from s)
    select vec_id, list_sum(c)::bigint as code_sum, round(s, 6) as scale, round(list_max(list_transform(list_zip(e, c), lambda p: abs(p[1] - p[2] / 127 * s))), 6) as worst from c"""
)
def int8_roundtrip(spark, folder):
    q = F.col("q")
    e = table(spark, folder, "embeddings").select("vec_id", "embedding", V.quantize(F.col("embedding")).alias("q"))
    off = F.array_max(F.zip_with("embedding", V.dequantize(q), lambda a, b: F.abs(a.cast("double") - b)))
    return e.select(
        "vec_id", F.aggregate(q["codes"], F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"),
        F.round(q["scale"], 6).alias("scale"), F.round(off, 6).alias("worst"),
    )


def memo_chunks(spark, folder):
    m = memo(spark, folder).select(
        F.col("event_id").alias("para_id"), F.col("project").alias("source"), "name",
        F.expr("concat(case when event_id % 10 = 0 then 'docs/internal/' else 'notes/' end, project, '/', name)").alias("path"),
        F.col("day").alias("date"), F.lit("note").alias("doc_type"), F.lit(0).alias("para_idx"), "text",
    )
    return X.chunk_table(m, private=("docs/internal",))


@query(
    rf"""with m as (select project, name, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from {MEMO_SQL} where event_id % 10 <> 0)
    select project as source, count(*) as n_chunks, count(distinct sha256(t)) as n_contents from m where length(t) <= 600 group by 1"""
)
def vector_chunks(spark, folder):
    return memo_chunks(spark, folder).groupBy("source").agg(F.count("*").alias("n_chunks"), F.count_distinct("content_hash").alias("n_contents"))


@query(
    """with c as (select case when p_partkey % 40 = 0 then '' else 'c' || (p_partkey % 150) end as chunk_id, case when p_partkey % 50 = 0 then ' ' else p_name end as text from part)
    select 'duplicate chunk_id' as problem, count(*) as n from (select chunk_id from c group by 1 having count(*) > 1) union all
    select 'empty chunk_id', count(*) from c where trim(chunk_id) = '' union all select 'empty text', count(*) from c where trim(text) = ''"""
)
def chunk_problems(spark, folder):
    c = table(spark, folder, "part").selectExpr(
        "case when p_partkey % 40 = 0 then '' else concat('c', p_partkey % 150) end as chunk_id", "case when p_partkey % 50 = 0 then ' ' else p_name end as text"
    )
    return X.chunk_problems(c)


@query(
    f"""with d as (select doc_id, sha256(text) as h from documents), s as (select distinct h from d where doc_id % 3 <> 0)
    select 'kept' as part, count(*) as n from d where h in (select h from s) union all select 'pending', count(*) from d where h not in (select h from s)"""
)
def vector_reuse(spark, folder):
    """Documents whose content already has a vector, and those still to embed."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", F.sha2("text", 256).alias("content_hash"))
    stored = d.where("doc_id % 3 <> 0").select("content_hash", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    kept, pending = X.reuse_vectors(d, stored)
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return one(kept, "kept").unionByName(one(pending, "pending"))


def count_vector(texts: list[str]) -> np.ndarray:
    """Stand-in provider: letter counts of each text."""
    return np.array([[t.count(ch) + 1.0 for ch in "abcdefghij"] for t in texts])


@query()
def vector_build(spark, folder):
    """Chunks embedded through a provider function in batches, new content only."""
    chunks = memo_chunks(spark, folder)
    stored = X.embed(chunks.where("source = 'alder'"), count_vector).select("content_hash", "embedding")
    built = X.build_vectors(chunks, settle(stored), count_vector)
    return built.select("chunk_id", "source", F.round(V.norm(F.col("embedding")), 9).alias("length"))


@query("select label, count(*) as n, cast(floor(count(*) * 64 * 4 * 1.25) + count(*) * 512 as bigint) as bytes from embeddings group by 1")
def storage_estimate(spark, folder):
    n = F.col("n")
    per = table(spark, folder, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return per.select("label", "n", V.storage_bytes(n, 64).cast("bigint").alias("bytes"))


@query()
def corpus_fingerprint(spark, folder):
    return X.fingerprint(memo_chunks(spark, folder))


@query(
    rf"""with m as (select event_id, project, name, trim(regexp_replace(text, '\s+', ' ', 'g')) as t, 'notes/' || project || '/' || name as path, (length(trim(regexp_replace(text, '\s+', ' ', 'g'))) - length(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?i)alice', '', 'g'))) // 5 as n from {MEMO_SQL} where event_id % 10 <> 0)
    select project as source, regexp_replace(t, '(?i)alice', '[X]', 'g') as text, path, n::int as redactions from m where project = 'alder' and length(regexp_replace(t, '(?i)alice', '[X]', 'g')) <= 600"""
)
def public_results(spark, folder):
    found = memo_chunks(spark, folder).withColumn("score", F.lit(1.0))
    out = X.public_view(found, ["alder", "birch"], ["notes/alder"], ["Alice"], ["path"], "[X]")
    return out.select("source", "text", F.col("metadata")["path"].alias("path"), "redactions")

