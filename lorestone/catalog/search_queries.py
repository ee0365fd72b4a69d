"""Queries for the index, ranking and search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.vectors import unit
from ..operators import blockindex as B
from ..operators import index as I
from ..operators import search as S
from ..plans.scale import by_score, top_per_key
from ..session import new_folder, settle
from .base import MEMO_SQL, derive, derive_sql, memo, query, table
from .text_queries import _TRACE_TOKENS, chain_sql, words_sql

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_]{{2,}}')"


def bm25_sql(paras: str, queries: str, tf: str = "tf", keep: str = "true", inner: bool = False) -> str:
    """CTEs ending in ``scores(query_id, para_id, score)``."""
    return f"""p as (select * from {paras}), qs as (select * from {queries}),
    pt as (select para_id, unnest({TOKENS.format('text')}) as token from p),
    ptf as (select para_id, token, count(*) as tf from pt group by 1, 2),
    plen as (select para_id, count(*) as len from ptf group by 1),
    st as (select count(*) as n, sum(coalesce(len, 0)) / count(*) as avg_len from p left join plen using (para_id)),
    pdf as (select token, count(*) as df from ptf group by 1),
    qt as (select distinct query_id, unnest({TOKENS.format('query')}) as token from qs),
    scores as (select query_id, ptf.para_id, sum(ln(1 + n / (1 + df)) * {tf} * 2.5 / ({tf} + 1.5 * (0.25 + 0.75 * len / avg_len))) as score
      from qt join ptf using (token) join pdf using (token) join plen on plen.para_id = ptf.para_id cross join st
      where ptf.para_id in (select para_id from p where {keep}) group by 1, 2)"""


def rank_sql(source: str, k: int, id_col: str = "para_id") -> str:
    return f"""select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, {id_col}) as rank from {source}) where rank <= {k}"""


def documents_as_paragraphs(spark, folder):
    """Every document as one search unit."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("para_id"), "text", "source", "lang", "n_chars"
    )


def benchmark_queries(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


DOC_P = "(select doc_id as para_id, text, source, lang, n_chars from documents)"
BENCH_Q = "(select item_id as query_id, text as query from benchmark)"


@query(
    f"with {bm25_sql(DOC_P, BENCH_Q)} select query_id, para_id, round(score, 6) as score, rank from ({rank_sql('scores', 10)})"
)
def bm25_topk(spark, folder):
    top = I.bm25_top(documents_as_paragraphs(spark, folder), benchmark_queries(spark, folder), 10)
    return top.select("query_id", "para_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""with {bm25_sql(DOC_P, BENCH_Q, keep="contains(source, 'src1') and lang = 'en'")}
    select query_id, para_id, round(score, 6) as score, rank from ({rank_sql('scores', 5)})"""
)
def bm25_filtered(spark, folder):
    docs = documents_as_paragraphs(spark, folder)
    keep = F.lower("source").contains("src1") & (F.col("lang") == "en")
    top = I.bm25_top(docs, benchmark_queries(spark, folder), 5, candidates=keep)
    return top.select("query_id", "para_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {bm25_sql(DOC_P, BENCH_Q)} select query_id, para_id, round(score, 6) as score, rank from ({rank_sql('scores', 10)})")
def stored_index_search(spark, folder):
    """BM25 over an index written to the shared folder and read back by token bucket."""
    out = new_folder(spark)
    I.write_index(documents_as_paragraphs(spark, folder).select("para_id", "text"), out, buckets=8)
    top = I.search_index(spark, out, benchmark_queries(spark, folder), 10, buckets=8)
    return top.select("query_id", "para_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {bm25_sql(DOC_P, BENCH_Q)} select query_id, para_id, round(score, 6) as score, rank from ({rank_sql('scores', 10)})")
def block_search(spark, folder):
    """The same best paragraphs, from blocks of postings of which only those that can matter are scored."""
    out = new_folder(spark)
    B.write_blocks(documents_as_paragraphs(spark, folder).select("para_id", "text"), out, width=16, buckets=8)
    top, _ = B.search_blocks(spark, out, benchmark_queries(spark, folder), 10)
    return top.select("query_id", "para_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""with {bm25_sql(DOC_P, BENCH_Q)},
    w as (select token, para_id, ln(1 + n / (1 + df)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) as weight from ptf join pdf using (token) join plen using (para_id) cross join st),
    sig as (select para_id, min(md5(token)) as s, count(*) as m from ptf group by 1),
    pl as (select para_id, (row_number() over (order by s, m, para_id) - 1) // 16 as range from sig),
    bl as (select query_id, range, token, max(weight) as top from w join pl using (para_id) join qt using (token) group by 1, 2, 3),
    bo as (select query_id, range, sum(top) as bound, count(*) as n from bl group by 1, 2),
    first as (select query_id, range from bo qualify row_number() over (partition by query_id order by round(bound, 9) desc, range) <= {B.PROBED + 1}),
    th as (select query_id, score from (select query_id, score, row_number() over (partition by query_id order by score desc) as r from scores join pl using (para_id) join first using (query_id, range)) where r = 10),
    kept as (select bo.*, f.range is not null or th.score is null or bound >= th.score - 1e-8 as hit from bo left join first f using (query_id, range) left join th using (query_id))
    select query_id, sum(n)::bigint as n_blocks, sum(case when hit then n else 0 end)::bigint as n_scored from kept group by 1"""
)
def block_savings(spark, folder):
    """Blocks of the query tokens, and those that had to be scored, per query."""
    out = new_folder(spark)
    B.write_blocks(documents_as_paragraphs(spark, folder).select("para_id", "text"), out, width=16, buckets=8)
    return B.search_blocks(spark, out, benchmark_queries(spark, folder), 10)[1]


@query(
    """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_]{2,}')) as token from documents),
    d as (select token, count(distinct doc_id) as df from t group by 1)
    select token, df, round(ln(1 + (select count(*) from documents) / (1 + df)), 9) as idf from d"""
)
def token_idf(spark, folder):
    docs = documents_as_paragraphs(spark, folder)
    stats = I.token_stats(I.postings(docs), I.corpus_stats(docs))
    return stats.select("token", "df", F.round("idf", 9).alias("idf"))


#: questions of a small fixed shape, one per nation
_ASK = {
    "query_id": "cast(n_nationkey as bigint)",
    "query": """case n_nationkey % 8
 when 0 then concat('When did ', split_part('Alice,Bruno,Carla,Dmitri,Elena,Farid,Greta,Hugo', ',', cast(1 + n_nationkey % 7 as int)), ' first join Team Oslo?')
 when 1 then 'What did we decide about the Alder plan?'
 when 2 then concat('Where is the src/cache_file_reader.py module for ', split_part('Oslo,Lima,Kyoto,Quito,Riga,Turin', ',', cast(1 + n_nationkey % 6 as int)), '?')
 when 3 then 'What went wrong with the parser in Riga?'
 when 4 then concat('Would ', split_part('Alice,Bruno,Carla,Dmitri,Elena,Farid,Greta,Hugo', ',', cast(1 + n_nationkey % 8 as int)), ' like the job in Lima?')
 when 5 then 'What accuracy score was measured?'
 when 6 then 'What is the latest status in Kyoto?'
 else 'How many pages did Hugo Books sell in Turin?' end""",
}


def nation_questions(spark, folder):
    return derive(table(spark, folder, "nation"), _ASK)


ASK_SQL = f"({derive_sql('nation', _ASK)})"

_KIND = chain_sql([(n, words_sql("lower(text)", w)) for n, w in fixed.PARAGRAPH_TYPES], "discussion")
_UNIT = {
    "para_id": "event_id", "doc_id": "event_id", "para_idx": "0", "text": "body", "name": "name",
    "source": "project", "path": "concat('notes/', project, '/', name)", "date": "day",
    "doc_type": "case when event_type = 'error' then 'code' else 'note' end",
}


def memo_paragraphs(spark, folder):
    m = derive(memo(spark, folder), _UNIT)
    return m.withColumn("para_type", T.classify_paragraph(F.col("text")))


MEMO_P = f"(select *, {_KIND} as para_type from ({derive_sql(MEMO_SQL, _UNIT)}))"

_INTENT = chain_sql([(n, words_sql("lower(query)", w)) for n, w, _ in fixed.QUERY_INTENTS], "general")
_BOOST_OF = "case intent " + " ".join(
    f"when '{n}' then para_type in ({','.join(repr(x) for x in b)})" for n, _, b in fixed.QUERY_INTENTS if b
) + " else false end"
_DATE_RE = (
    r"(?i)\d{4}-\d{2}-\d{2}|(?:" + fixed.MONTH_NAMES + r")\s+\d{1,2}|\b(?:yesterday|today|last\s+(?:week|month|year))\b"
)
_PERSON = (
    r"regexp_matches(query, '(?i)\b(?:relationship|hobby|hobbies|interest|interests|career|job|status|personality|feel|feeling|prefer|favorite|partake|destress|self-care|political|leaning|member|community)\b') or "
    + words_sql("lower(query)", fixed.PERSON_CENTRIC_WORDS)
)
_AGE = "datediff('day', cast(date as date), date '2024-01-31')"
BOOSTED = rf"""q1 as (select *, {_INTENT} as intent,
      case when {_PERSON} then list_filter(list_transform(regexp_extract_all(query, '\b[A-Z][a-z][a-z]+\b'), lambda x: lower(x)),
        lambda x: x not in ({",".join(f"'{w}'" for w in fixed.QUERY_NAME_STOPWORDS)})) else [] end as names,
      list_filter(list_distinct({TOKENS.format('query')}), lambda x: x not in ({",".join(f"'{w}'" for w in fixed.LOCATION_STOPWORDS)}) and not regexp_full_match(x, '\d+')) as terms
      from qs),
    b as (select q1.query_id, q1.query, q1.intent, p.*, score
      * case when {_BOOST_OF} then 1.5 else 1 end
      * case when intent = 'location' then case when doc_type = 'code' then 2.0 * (1 + 0.4 * least(3, len(list_filter(terms,
          lambda t: contains(lower(text), t) or contains(lower(name), t) or contains(lower(path), t))))) else 0.6 end else 1 end
      * case when intent = 'status' or (intent = 'temporal' and {words_sql('lower(query)', fixed.RECENT_WORDS)})
          then case when {_AGE} <= 2 then 1.8 when {_AGE} <= 5 then 1.4 when {_AGE} <= 14 then 1.2 else 1 end else 1 end
      * case when intent = 'temporal' and regexp_matches(text, '{_DATE_RE}') then 1.4 else 1 end
      * case when len(list_filter(names, lambda x: contains(lower(text), x))) > 0 then 1.3 else 1 end as bscore
      from scores join p using (para_id) join q1 using (query_id))"""


@query(
    f"""with {bm25_sql(MEMO_P, ASK_SQL)}, {BOOSTED}, r as (select query_id, para_id, bscore as score from b)
    select query_id, para_id, round(score, 6) as score, rank from ({rank_sql('r', 10)})"""
)
def boosted_search(spark, folder):
    top = S.boosted_top(
        memo_paragraphs(spark, folder), nation_questions(spark, folder), F.lit("2024-01-31").cast("date"), 10
    )
    return top.select("query_id", "para_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""with {bm25_sql(MEMO_P, ASK_SQL, keep="(contains(lower(source), 'birch') or contains(lower(name), 'birch')) and (date = '' or date >= '2024-01-10') and (date = '' or date <= '2024-01-25') and contains(lower(doc_type), 'note')")}
    select query_id, para_id, round(score, 6) as score, rank from ({rank_sql('scores', 5)})"""
)
def structured_filters(spark, folder):
    keep = S.structured_filter("Birch", "2024-01-10", "2024-01-25", "note")
    top = I.bm25_top(memo_paragraphs(spark, folder), nation_questions(spark, folder), 5, candidates=keep)
    return top.select("query_id", "para_id", F.round("score", 6).alias("score"), "rank")


@query()
def full_search(spark, folder):
    """Search with answers, dated events in front, confidence and agreement."""
    events = memo(spark, folder).select("event_id", F.col("name").alias("source"), F.col("day").alias("date"), F.col("body").alias("text"))
    found = S.search(
        memo_paragraphs(spark, folder), nation_questions(spark, folder), F.lit("2024-01-31").cast("date"), k=5, events=events
    )
    return found.select(
        "query_id", "rank", "doc_id", "name", "source", "score", "snippet", "para_idx", "answer", "confidence"
    )


@query()
def multi_hop_search(spark, folder):
    """Two sub-queries per question, joined and re-ranked by the whole question."""
    hop = {
        "query_id": "cast(n_nationkey as bigint)",
        "query": "concat('What happened before ', split_part('Alice,Bruno,Carla,Dmitri,Elena,Farid,Greta,Hugo', ',', cast(1 + n_nationkey % 8 as int)), ' moved to Riga?')",
    }
    asked = derive(table(spark, folder, "nation"), hop)
    parts = asked.select("query_id", F.posexplode(T.decompose_query(F.col("query"))).alias("part", "query"))
    keyed = parts.select((F.col("query_id") * 10 + F.col("part")).alias("query_id"), "query")
    found = S.search(memo_paragraphs(spark, folder), keyed, F.lit("2024-01-31").cast("date"), k=5)
    found = found.withColumn("query_id", F.floor(F.col("query_id") / 10))
    return S.multi_hop(found, asked, 5).select("query_id", "name", "rank", F.round("merged_score", 4).alias("score"))


@query(
    f"""with {bm25_sql(DOC_P, BENCH_Q)}, a as ({rank_sql('scores', 50)}),
    s2 as (select query_id, para_id, p.n_chars::double as score from a join p using (para_id)),
    b as ({rank_sql('s2', 50)}),
    f as (select query_id, para_id, sum(1.0 / (60 + rank)) as score from (select query_id, para_id, rank from a union all select query_id, para_id, rank from b) group by 1, 2)
    select query_id, para_id, round(score, 9) as score, rank from ({rank_sql('f', 10)})"""
)
def rrf_fusion(spark, folder):
    docs = documents_as_paragraphs(spark, folder)
    # read twice: by score, and for the lengths
    lexical = settle(I.bm25_top(docs, benchmark_queries(spark, folder), 50))
    by_size = top_per_key(
        lexical.drop("rank", "score").join(docs.select("para_id", F.col("n_chars").cast("double").alias("score")), "para_id"),
        ["query_id"], by_score("para_id"), 50,
    )
    fused = S.reciprocal_ranks([lexical, by_size], "para_id")
    top = top_per_key(fused, ["query_id"], by_score("para_id"), 10)
    return top.select("query_id", "para_id", F.round("score", 9).alias("score"), "rank")


_VEC = """v as (select vec_id as para_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as e from embeddings)"""


@query(
    f"""with {bm25_sql(DOC_P, BENCH_Q)}, {_VEC}, h as ({rank_sql('scores', 30)}),
    s2 as (select h.query_id, h.para_id, list_dot_product(a.e, c.e) as score from h join v a on a.para_id = h.para_id join v c on c.para_id = h.query_id),
    r2 as ({rank_sql('s2', 30)}),
    f as (select query_id, para_id, sum(1.0 / (60 + rank)) as score from (select query_id, para_id, rank from h union all select query_id, para_id, rank from r2) group by 1, 2)
    select query_id, para_id, round(score, 9) as score, rank from ({rank_sql('f', 5)})"""
)
def dense_rerank(spark, folder):
    """Lexical candidates fused with stored vectors (vector ids double as document and query ids)."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("para_id"), unit(F.col("embedding")).alias("embedding")
    )
    asked = vectors.withColumnRenamed("para_id", "query_id")
    scores = I.bm25_top(documents_as_paragraphs(spark, folder), benchmark_queries(spark, folder), 30).drop("rank")
    fused = S.dense_rerank(scores, asked, vectors, 5)
    top = top_per_key(fused, ["query_id"], by_score("para_id"), 5)
    return top.select("query_id", "para_id", F.round("score", 9).alias("score"), "rank")


@query(
    f"""with {bm25_sql(DOC_P, BENCH_Q, tf="1.0")}, {_VEC},
    sim as (select q.query_id, a.para_id, list_dot_product(a.e, c.e) as similarity from qs q join v c on c.para_id = q.query_id cross join v a
       where list_dot_product(a.e, c.e) > 0.2),
    j as (select query_id, para_id, score, similarity from scores full outer join sim using (query_id, para_id)),
    m as (select query_id, greatest(max(score), 1e-6) as b, greatest(max(similarity), 1e-6) as e from j group by 1),
    f as (select query_id, para_id, 0.4 * coalesce(score, 0) / b + 0.6 * coalesce(similarity, 0) / e as score from j join m using (query_id))
    select query_id, para_id, round(score, 6) as score, rank from ({rank_sql("(select * from f where score > 0 and para_id in (select para_id from p))", 30)})"""
)
def hybrid_scoring(spark, folder):
    from ..operators.vectorindex import similar_above

    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("para_id"), "embedding")
    asked = benchmark_queries(spark, folder)
    probes = vectors.join(asked.select(F.col("query_id").alias("para_id")), "para_id", "left_semi").withColumnRenamed("para_id", "query_id")
    sims = similar_above(vectors.withColumnRenamed("para_id", "vec_id"), probes, 0.2).select(
        "query_id", F.col("vec_id").alias("para_id"), "similarity"
    )
    found = S.hybrid_scores(documents_as_paragraphs(spark, folder), asked, sims, 10)
    return found.select("query_id", "para_id", F.round("score", 6).alias("score"), "rank")




@query(
    f"""with d as (select doc_id as trace_id, concat(lang, '-', source, '_', doc_id, '.md') as name, text from documents),
    t as (select trace_id, {_TRACE_TOKENS.format('text')} as b, {_TRACE_TOKENS.format("translate(name, '-_', '  ')")} as m,
      {_TRACE_TOKENS.format("text || ' ' || translate(name, '-_', '  ')")} as j from d),
    tf as (select trace_id, term, sum(w) as tf from (
        select trace_id, unnest(b) as term, 1 as w from t union all select trace_id, unnest(list_transform(list_zip(b[:-2], b[2:]), lambda p: p[1] || '_' || p[2])), 1 from t
        union all select trace_id, unnest(m), 3 from t union all select trace_id, unnest(list_transform(list_zip(m[:-2], m[2:]), lambda p: p[1] || '_' || p[2])), 3 from t) group by 1, 2),
    df as (select term, count(*) as df from (select distinct trace_id, term from (select trace_id, unnest(j) as term from t
        union all select trace_id, unnest(list_transform(list_zip(j[:-2], j[2:]), lambda p: p[1] || '_' || p[2])) from t)) group by 1),
    q as (select item_id as query_id, {_TRACE_TOKENS.format('text')} as q from benchmark),
    qt as (select query_id, list_distinct(list_concat(q, list_transform(list_zip(q[:-2], q[2:]), lambda p: p[1] || '_' || p[2]))) as terms from q where len(q) >= 2),
    x as (select query_id, len(terms) as n, unnest(terms) as term from qt),
    s as (select query_id, trace_id, sum((1 + ln(tf)) * ln(1 + (select count(*) from d) / (1 + df)) / n) as score from x join tf using (term) join df using (term) group by 1, 2)
    select query_id, trace_id, round(score, 6) as kw_score, rank from ({rank_sql('s', 5, 'trace_id')})"""
)
def tfidf_bigrams(spark, folder):
    traces = table(spark, folder, "documents").select(
        F.col("doc_id").alias("trace_id"),
        F.concat("lang", F.lit("-"), "source", F.lit("_"), "doc_id", F.lit(".md")).alias("name"), "text",
    )
    top = I.tfidf_top(traces, benchmark_queries(spark, folder), 5)
    return top.select("query_id", "trace_id", F.round("kw_score", 6).alias("kw_score"), "rank")


@query(
    f"""with t as (select distinct doc_id as item_id, unnest({TOKENS.format('text')}) as token from documents),
    q as (select item_id as query_id, list_distinct({TOKENS.format('text')}) as q from benchmark),
    x as (select query_id, len(q) as n, unnest(q) as token from q),
    s as (select query_id, item_id, count(*) / any_value(n) as score from x join t using (token) group by 1, 2)
    select query_id, item_id, round(score, 9) as score, rank from ({rank_sql('s', 5, 'item_id')})"""
)
def knowledge_search(spark, folder):
    items = table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text")
    found = S.token_share_search(items, benchmark_queries(spark, folder), 5)
    return found.select("query_id", "item_id", F.round("score", 9).alias("score"), "rank")


@query(
    f"""with w as (select doc_id, source, text from documents where n_chars between 50 and 1000000)
    select source, count(*) as n_documents, count(distinct sha256(text)) as n_contents from w group by 1"""
)
def index_sources(spark, folder):
    """Documents per source that enter the index, with their distinct contents."""
    docs = table(spark, folder, "documents").where(F.length("text").between(I.MIN_FILE_CHARS, I.MAX_FILE_CHARS))
    hashed = docs.select("source", F.sha2("text", 256).alias("h"))
    per = hashed.groupBy("source", "h").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_contents"))


@query(
    f"""with base as (select doc_id, source, text, source || '/' || doc_id as path from documents),
    changed as (select path from base where doc_id % 5 = 0),
    u as (select path, source, text from base where path not in (select path from changed)
      union all select path, source, 'Replaced content of the file with the path ' || path || '.' from base where path in (select path from changed))
    select path, source, md5(text) as digest from u where length(text) >= 30"""
)
def replaced_files(spark, folder):
    """Incremental update: every fifth path comes in again with new content."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("source"), F.concat("source", F.lit("/"), "doc_id").alias("path"), "text"
    ).withColumn("name", F.col("path"))
    changed = docs.where("doc_id % 5 = 0").withColumn(
        "text", F.concat(F.lit("Replaced content of the file with the path "), "path", F.lit("."))
    )
    current = docs.where(F.length("text") >= 30).select(
        F.col("doc_id").alias("para_id"), "doc_id", "source", "path", "name", "text"
    )
    merged = I.replace_documents(current, changed)
    return merged.select("path", "source", F.md5("text").alias("digest"))


