"""Queries for the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed
from ..functions import text as T
from ..functions.code import code_spans, split_code
from .base import MEMO_SQL, memo, query, table

W = r"[\p{L}\p{N}_]"  # word character in the SQL dialect
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def bar(c):
    """Array as one comparable string."""
    return F.array_join(c, "|")


def words_sql(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def chain_sql(rules: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when {c} then '{n}'" for n, c in rules) + f" else '{default}' end"


def q(s: str) -> str:
    return s.replace("'", "''")


@query(
    """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_]{2,}')) as token from documents),
    c as (select doc_id, token, count(*) as tf from t group by 1, 2)
    select doc_id, sum(tf)::bigint as n_tokens, count(*) as n_unique, max(tf) as max_tf from c group by 1"""
)
def token_counts(spark, folder):
    tokens = table(spark, folder, "documents").select(
        "doc_id", F.explode(T.index_tokens(F.col("text"))).alias("token")
    )
    tf = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return tf.groupBy("doc_id").agg(
        F.sum("tf").alias("n_tokens"), F.count("*").alias("n_unique"), F.max("tf").alias("max_tf")
    )


_STOP = "(" + ",".join(f"'{w}'" for w in fixed.TRACE_STOPWORDS) + ")"
_TRACE_TOKENS = (
    "list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda w: length(w) > 1 and w not in " + _STOP + ")"
)
_STEM = "case " + " ".join(
    f"when suffix(w, '{s}') and length(w) >= {len(s) + 3} then substr(w, 1, length(w) - {len(s)})"
    for s in fixed.STEM_SUFFIXES
) + " else w end"


@query(
    f"""with t as (select doc_id, {_TRACE_TOKENS.format('text')} as t from documents),
    s as (select doc_id, t, list_distinct(list_transform(t, lambda w: {_STEM})) as stems from t)
    select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_unique, len(stems) as n_stems,
      len(list_distinct(list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || '_' || p[2]))) as n_bigrams,
      list_aggregate(list_sort(stems)[1:5], 'string_agg', ' ') as first_stems
    from s where len(t) >= 2""",
    name="trace_terms",
)
def trace_terms(spark, folder):
    t = F.col("t")
    stems = F.array_distinct(F.transform(t, T.stem))
    return (
        table(spark, folder, "documents")
        .select("doc_id", T.trace_tokens(F.col("text")).alias("t"))
        .where(F.size("t") >= 2)
        .select(
            "doc_id",
            F.size(t).alias("n_tokens"),
            F.size(F.array_distinct(t)).alias("n_unique"),
            F.size(stems).alias("n_stems"),
            F.size(F.array_distinct(T.bigrams(t))).alias("n_bigrams"),
            F.array_join(F.slice(F.array_sort(stems), 1, 5), " ").alias("first_stems"),
        )
    )


@query(
    f"""with t as (select event_id, question, {_TRACE_TOKENS.format('question')} as t from {MEMO_SQL})
    select event_id, trim(question || ' ' || array_to_string(list_sort(list_distinct(list_filter(
      list_transform(t, lambda w: {_STEM}), lambda w: not list_contains(t, w)))), ' ')) as expanded from t"""
)
def expand_queries(spark, folder):
    return memo(spark, folder).select("event_id", T.expand_query(F.col("question")).alias("expanded"))


def _sentences_sql(column: str) -> str:
    return rf"string_split(regexp_replace({column}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(
    f"""with b as (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format('x')}),
        lambda x: length(x) >= 30) as blocks, text from documents),
    u as (select doc_id, text, unnest(blocks) as block, generate_subscripts(blocks, 1) as b_no from b),
    s as (select *, list_filter(list_transform({_sentences_sql('block')}, lambda x: {STRIP.format('x')}), lambda x: length(x) > 10) as s from u),
    w as (select doc_id, b_no, case when length(block) <= 200 or len(s) <= 2 then [block]
        else list_filter(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[greatest(i - 1, 1):i + 1], ' ')), lambda x: length(x) > 30) end as units from s),
    f as (select doc_id, list_transform(flatten(list(units order by b_no)), lambda x: substr(x, 1, 10000)) as units from w group by 1),
    a as (select d.doc_id, case when len(coalesce(units, [])) > 0 then units
        when length({STRIP.format('d.text')}) > 30 then [substr({STRIP.format('d.text')}, 1, 2000)] else [] end as units
        from documents d left join f using (doc_id))
    select doc_id, unnest(list_transform(units, lambda x: md5(x))) as unit_md5, generate_subscripts(units, 1) - 1 as para_idx,
      unnest(list_transform(units, lambda x: length(x))) as n_chars from a"""
)
def paragraph_units(spark, folder):
    units = table(spark, folder, "documents").select(
        "doc_id", F.posexplode_outer(T.split_paragraphs(F.col("text"))).alias("para_idx", "unit")
    ).where("unit is not null")
    return units.select("doc_id", "para_idx", F.md5("unit").alias("unit_md5"), F.length("unit").alias("n_chars"))


@query(
    f"""with s as (select conv_id, turn, list_filter(list_transform({_sentences_sql('text')}, lambda x: {STRIP.format('x')}),
        lambda x: length(x) >= 10) as s, {STRIP.format('text')} as whole from conversations),
    a as (select conv_id, turn, case when len(s) > 0 then s when whole <> '' then [whole] else [] end as s from s)
    select conv_id, turn, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as pos from a""",
)
def fact_sentences(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(T.fact_sentences(F.col("text"))).alias("pos", "sentence")
    )


@query(
    "select event_id, "
    + chain_sql([(n, words_sql("lower(text)", w)) for n, w in fixed.PARAGRAPH_TYPES], "discussion")
    + f" as para_type from {MEMO_SQL} union all select -1 - doc_id, "
    + chain_sql([(n, words_sql("lower(text)", w)) for n, w in fixed.PARAGRAPH_TYPES], "discussion")
    + " from documents"
)
def paragraph_types(spark, folder):
    notes = memo(spark, folder).select("event_id", T.classify_paragraph(F.col("text")).alias("para_type"))
    docs = table(spark, folder, "documents").select(
        (-1 - F.col("doc_id")).alias("event_id"), T.classify_paragraph(F.col("text")).alias("para_type")
    )
    return notes.unionByName(docs)


_INTENT = chain_sql([(n, words_sql("lower(question)", w)) for n, w, _ in fixed.QUERY_INTENTS], "general")


@query(
    f"""with i as (select event_id, question, {_INTENT} as intent from {MEMO_SQL})
    select event_id, intent, case intent {' '.join(f"when '{n}' then '{'|'.join(b)}'" for n, _, b in fixed.QUERY_INTENTS)} else '' end as boosts,
      intent = 'status' or (intent = 'temporal' and {words_sql('lower(question)', fixed.RECENT_WORDS)}) as recency from i"""
)
def query_intents(spark, folder):
    i = F.col("i")
    return (
        memo(spark, folder)
        .select("event_id", T.classify_query(F.col("question")).alias("i"))
        .select("event_id", i["type"].alias("intent"), bar(i["boost_types"]).alias("boosts"), i["recency"].alias("recency"))
    )


@query(
    f"""with s as (select event_id, unnest({_sentences_sql('body')}) as s, generate_subscripts({_sentences_sql('body')}, 1) - 1 as pos from {MEMO_SQL})
    select event_id, pos, {chain_sql([(n, f"regexp_matches(s, '(?i){q(p)}')") for n, p in fixed.FACT_CLASSES], 'event')} as fact_type,
      regexp_matches(s, '(?i){q(fixed.CHANGE_VERBS)}') as supersedes from s where length(s) >= 10"""
)
def fact_types(spark, folder):
    s = F.col("s")
    return (
        memo(spark, folder)
        .select("event_id", F.posexplode_outer(T.fact_sentences(F.col("body"))).alias("pos", "s")).where("s is not null")
        .select("event_id", "pos", T.classify_fact(s).alias("fact_type"), T.has_change_verb(s).alias("supersedes"))
    )


_KEYWORDS = r"""list_sort(list_distinct(list_concat(
   list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{4,}'), lambda x: len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{4,}'), lambda y: y = x)) >= 2),
   list_transform(list_filter(regexp_extract_all(text, '[A-Z][a-z]+(?:[A-Z][a-z]+)*'), lambda x: length(x) > 3), lambda x: lower(x)),
   regexp_extract_all(text, 'v\d+\.\d+(?:\.\d+)?'))))[1:20]"""


@query(
    rf"""select event_id, array_to_string({_KEYWORDS}, '|') as keywords,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?%'))), '|') as percentages,
      substr(sha256(substr(text, 1, 200) || ':' || name), 1, 12) as note_id from {MEMO_SQL}"""
)
def note_keywords(spark, folder):
    c = F.col("text")
    return memo(spark, folder).select(
        "event_id",
        bar(T.extract_keywords(c)).alias("keywords"),
        bar(F.array_sort(T.percentage_tokens(c))).alias("percentages"),
        T.note_id(c, F.col("name")).alias("note_id"),
    )


def _terms_sql(terms: list[str], low: str) -> str:
    return "list_filter([" + ",".join(f"'{q(t)}'" for t in terms) + f"], lambda t: contains({low}, t))"


NOTE_ENTITIES_SQL = (
    "list_sort(list_distinct(list_concat(" + _terms_sql(fixed.NOTE_TERMS, "lower({0})")
    + r", regexp_extract_all({0}, 'v\d+\.\d+(?:\.\d+)?'), regexp_extract_all({0}, '\d+(?:\.\d+)?%'),"
    + r" list_transform(regexp_extract_all({0}, '(?:[.!?\n] |: )([A-Z][a-z][a-z]+)', 1), lambda x: lower(x)))))"
)


@query(f"select event_id, array_to_string({NOTE_ENTITIES_SQL.format('text')}, '|') as entities from {MEMO_SQL}")
def note_entities(spark, folder):
    return memo(spark, folder).select("event_id", bar(T.note_entities(F.col("text"))).alias("entities"))


@query(
    rf"""select event_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
      regexp_extract_all(text, '(?:^|\.\s+|!\s+|\?\s+|\n\s*)([A-Z][a-z][a-z]+)\b', 1), lambda x: lower(x)),
      lambda x: x not in ({",".join(f"'{w}'" for w in fixed.NAME_STOPWORDS)})))), '|') as names from {MEMO_SQL}"""
)
def person_names(spark, folder):
    return memo(spark, folder).select("event_id", bar(T.person_names(F.col("text"))).alias("names"))


SIMPLE_ENTITIES_SQL = (
    r"list_concat(list_filter(regexp_extract_all('. ' || {0}, '(?:[.!?] )?\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'),"
    r" lambda x: not regexp_matches(x, '^[.!?] ')), "
    r"""regexp_extract_all({0}, '"([^"]{{2,40}})"', 1))"""
)


@query(f"select event_id, array_to_string({SIMPLE_ENTITIES_SQL.format('body')}, '|') as entities from {MEMO_SQL}")
def simple_entities(spark, folder):
    return memo(spark, folder).select("event_id", bar(T.simple_entities(F.col("body"))).alias("entities"))


@query(
    rf"""with e as (select event_id, unnest(list_concat(
       {", ".join(f"list_transform({_terms_sql(t, 'lower(text)')}, lambda x: {{'text': x, 'label': '{n}', 'score': 0.5::double}})" for n, t in fixed.ENTITY_TERMS.items())},
       list_transform(regexp_extract_all(text, 'v\d+\.\d+(?:\.\d+)?'), lambda x: {{'text': x, 'label': 'version number', 'score': 0.6::double}}),
       list_transform(regexp_extract_all(text, '[\w/\\]+\.(?:py|rs|md|json|yaml|toml)\b'), lambda x: {{'text': regexp_replace(x, '^.*[/\\]', ''), 'label': 'file path', 'score': 0.5::double}})
       )) as e from {MEMO_SQL})
    select event_id, e.text as entity, e.label as label, e.score as score from e"""
)
def labelled_entities(spark, folder):
    rows = memo(spark, folder).select("event_id", F.inline(T.regex_entities(F.col("text"))))
    return rows.select("event_id", F.col("text").alias("entity"), "label", "score")


_TRACE_ENTITIES_SQL = (
    "list_sort(list_distinct(list_concat(" + _terms_sql([x.lower() for x in fixed.TRACE_CONCEPTS], "lower({0})")
    + r", regexp_extract_all({0}, 'v\d+\.\d+(?:\.\d+)?'), regexp_extract_all({0}, '\d+\.?\d*%'),"
    + r" list_transform(regexp_extract_all({0}, '[\w/\\]+\.(?:py|rs|md|json|yaml|toml)\b'), lambda x: regexp_replace(x, '^.*[/\\]', '')),"
    + r" list_filter(regexp_extract_all({0}, '\b[a-z][a-z_]+(?:_[a-z]+){{2,}}\b'), lambda x: length(x) > 8),"
    + r" regexp_extract_all({0}, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b'))))"
)
TRACE_ENTITIES_SQL = _TRACE_ENTITIES_SQL


@query(f"select event_id, array_to_string({TRACE_ENTITIES_SQL.format('text')}, '|') as entities from {MEMO_SQL}")
def trace_entities(spark, folder):
    return memo(spark, folder).select("event_id", bar(T.trace_entities(F.col("text"))).alias("entities"))


def relation_sql(between: str, default: str) -> str:
    return "case " + " ".join(
        f"when regexp_matches({between}, '(?i){p}') then '{n}'" for n, p in fixed.RELATION_PATTERNS
    ) + f" else {default} end"


@query(
    rf"""with e as (select event_id, text, {TRACE_ENTITIES_SQL.format('text')} as es from {MEMO_SQL}),
    p as (select event_id, text, unnest(es) as e, generate_subscripts(es, 1) as i from e),
    l as (select *, strpos(lower(text), lower(e)) - 1 as pos from p where strpos(lower(text), lower(e)) > 0),
    j as (select a.event_id, a.e as source, b.e as target, abs(a.pos - b.pos) as gap,
      substr(a.text, least(a.pos, b.pos) + 1, greatest(a.pos + length(a.e), b.pos + length(b.e)) - least(a.pos, b.pos)) as t
      from l a join l b on a.event_id = b.event_id and a.i < b.i),
    r as (select event_id, source, target, {relation_sql('t', "case when gap < 500 then 'co_occurs' end")} as relation from j)
    select * from r where relation is not null"""
)
def entity_relations(spark, folder):
    c = F.col("text")
    rows = memo(spark, folder).select("event_id", F.inline_outer(T.extract_relations(c, T.trace_entities(c))))
    return rows.where("source is not null").select("event_id", "source", "target", "relation")


@query(
    "select event_id, day as date, 'general' as project, "
    + chain_sql([(n, words_sql("lower(name)", w)) for n, w in fixed.TRACE_TYPES], "general")
    + f" as trace_type, day as document_date from {MEMO_SQL}"
)
def trace_metadata(spark, folder):
    m = F.col("m")
    return (
        memo(spark, folder)
        .select("event_id", T.trace_metadata(F.col("name")).alias("m"),
                T.document_date(F.col("text"), F.col("name")).alias("document_date"))
        .select("event_id", m["date"].alias("date"), m["project"].alias("project"),
                m["type"].alias("trace_type"), "document_date")
    )


@query(
    rf"""with b as (select event_id, unnest(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format('x')})) as b,
       generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as i from {MEMO_SQL})
    select event_id, count(*) as n_paragraphs, md5(string_agg(b, '|' order by i)) as digest from b
    where length(b) > 30 and not (b like '#%' and not contains(b, chr(10))) group by 1"""
)
def trace_paragraphs(spark, folder):
    p = F.col("p")
    return memo(spark, folder).select("event_id", T.trace_paragraphs(F.col("text")).alias("p")).select(
        "event_id", F.size(p).cast("bigint").alias("n_paragraphs"), F.md5(bar(p)).alias("digest")
    )


_CLEAN = rf"regexp_replace(regexp_replace({{0}}, '^[- *>]+', ''), '^\s+|\s+$', '', 'g')"


@query(
    rf"""with l as (select event_id, unnest(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')})) as line,
        generate_subscripts(string_split(text, chr(10)), 1) as i from {MEMO_SQL}),
    c as (select *, {_CLEAN.format('line')} as c, lead(line, 1) over w as l1, lead(line, 2) over w as l2 from l window w as (partition by event_id order by i)),
    k as (select event_id, i, c || case when length({_CLEAN.format('l1')}) > 10 and {_CLEAN.format('l1')} not like '#%' then ' ' || {_CLEAN.format('l1')} else '' end
        || case when length({_CLEAN.format('l2')}) > 10 and {_CLEAN.format('l2')} not like '#%' then ' ' || {_CLEAN.format('l2')} else '' end as k
      from c where line not like '#%' and length(c) > 20 and {words_sql('lower(line)', [q(w) for w in fixed.KEY_LINE_TRIGGERS])}),
    r as (select *, row_number() over (partition by event_id order by i) as rn from k)
    select event_id, (rn - 1)::int as pos, k as line from r where rn <= 30"""
)
def key_lines(spark, folder):
    return memo(spark, folder).select(
        "event_id", F.posexplode(T.extract_key_lines(F.col("text"))).alias("pos", "line")
    )


@query(
    rf"""select event_id, array_to_string(regexp_extract_all(body, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), '|') as dates,
      case when regexp_matches(body, '2 weeks after') then cast(cast(day as date) + 14 as string)
        when regexp_matches(body, '3 days before') then cast(cast(day as date) - 3 as string) else '' end as chained,
      true as has_date, round(2 * pi() * dayofyear(cast(day as date)) / 365.25, 9) as phase,
      case when datediff('day', cast(day as date), date '2024-01-31') <= 2 then 1.8 when datediff('day', cast(day as date), date '2024-01-31') <= 5 then 1.4
        when datediff('day', cast(day as date), date '2024-01-31') <= 14 then 1.2 else 1.0 end::double as recency from {MEMO_SQL}"""
)
def memo_dates(spark, folder):
    body, day = F.col("body"), F.to_date("day")
    return memo(spark, folder).select(
        "event_id",
        bar(D.extract_dates(body)).alias("dates"),
        bar(D.expand_chained_dates(body)).alias("chained"),
        D.has_date_expression(body).alias("has_date"),
        F.round(D.date_phase(day), 9).alias("phase"),
        D.recency_boost(day, F.lit("2024-01-31").cast("date")).alias("recency"),
    )


#: written, slashed and relative dates made from the order dates
_ORDER_DATES = """concat('Order ', o_orderkey, ' was placed on ', split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',', month(o_orderdate)),
 ' ', day(o_orderdate), ', ', year(o_orderdate), ' (', month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), '), paid ',
 1 + o_custkey % 9, ' ', split_part('days,weeks,months,years', ',', cast(1 + o_orderkey % 4 as int)), ' ago and shipped ',
 split_part('yesterday,today,last Monday,last week,this month,a few days ago,last year,the other day', ',', cast(1 + o_custkey % 8 as int)), '.')"""


@query(
    rf"""with o as (select o_orderkey, o_orderdate::date as d, o_custkey, 1 + o_custkey % 9 as n, o_orderkey % 4 as u, o_custkey % 8 as v,
       {_ORDER_DATES} as t from orders),
    r as (select *, case u when 0 then d - n::int when 1 then d - (7 * n)::int when 2 then d - to_months(n::int) else d - to_months((12 * n)::int) end::date as a,
      case v when 0 then d - 1 when 1 then d when 2 then d - (case when isodow(d) = 1 then 7 else isodow(d) - 1 end)::int when 3 then d - 7
        when 4 then date_trunc('month', d)::date when 5 then d - 3 when 6 then (d - to_years(1))::date else d - 3 end as b from o)
    select o_orderkey, array_to_string(list_sort(list_distinct(list_concat([cast(d as string), cast(a as string), cast(b as string)],
       case when v = 6 then [cast(date_trunc('month', d)::date - to_months(12) + to_days(least(day(d), 28)::int - 1) as date)::string] else [] end))), '|') as dates,
      cast(d as string) || '|' || cast(d as string) as plain,
      replace(replace(t, n || ' ' || split_part('days,weeks,months,years', ',', (1 + u)::int) || ' ago', 'on ' || cast(a as string) || ' (' || n || ' ' || split_part('days,weeks,months,years', ',', (1 + u)::int) || ' ago)'),
        'shipped ' || split_part('yesterday,today,last Monday,last week,this month,a few days ago,last year,the other day', ',', (1 + v)::int),
        'shipped on ' || cast(b as string) || ' (' || split_part('yesterday,today,last Monday,last week,this month,a few days ago,last year,the other day', ',', (1 + v)::int) || ')') as annotated
    from r"""
)
def order_text_dates(spark, folder):
    o = table(spark, folder, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("d"), F.expr(_ORDER_DATES).alias("t")
    )
    t, d = F.col("t"), F.col("d")
    return o.select(
        "o_orderkey",
        bar(D.parse_dates(t, d)).alias("dates"),
        bar(D.extract_dates(t)).alias("plain"),
        D.annotate_vague_dates(t, d).alias("annotated"),
    )


@query(
    rf"""with p as (select event_id, text, unnest(list_transform(range(1, len(string_split(text, day))), lambda i:
        ((list_sum(list_transform(string_split(text, day)[:i], lambda x: length(x))) + (i - 1) * length(day))::bigint))) as p0, day from {MEMO_SQL})
    select event_id, day as date, {STRIP.format("substr(text, greatest(p0 - 50, 0) + 1, p0 + length(day) + 100 - greatest(p0 - 50, 0))")} as context from p"""
)
def date_contexts(spark, folder):
    rows = memo(spark, folder).select("event_id", F.inline(D.date_contexts(F.col("text"))))
    return rows.select("event_id", "date", "context")


@query(
    rf"""select event_id, regexp_matches(question, '(?i)\b(?:relationship|hobby|hobbies|interest|interests|career|job|status|personality|feel|feeling|prefer|favorite|partake|destress|self-care|political|leaning|member|community)\b')
       or {words_sql('lower(question)', fixed.PERSON_CENTRIC_WORDS)} as person_centric,
      array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(question, '\b[A-Z][a-z][a-z]+\b'), lambda x: lower(x)),
        lambda x: x not in ({",".join(f"'{w}'" for w in fixed.QUERY_NAME_STOPWORDS)})))), '|') as names,
      array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9_]{{2,}}'),
        lambda x: x not in ({",".join(f"'{w}'" for w in fixed.LOCATION_STOPWORDS)}) and not regexp_full_match(x, '\d+')))), '|') as terms
      from {MEMO_SQL}"""
)
def question_terms(spark, folder):
    c = F.col("question")
    return memo(spark, folder).select(
        "event_id",
        T.is_person_centric(c).alias("person_centric"),
        bar(F.array_sort(T.query_names(c))).alias("names"),
        bar(F.array_sort(T.lookup_terms(c))).alias("terms"),
    )


_MULTI_HOP = """case event_id % 4 when 0 then concat('What hobby does the person who visited ', city, ' have?')
 when 1 then concat('Does the person who sold books also know ', who, '?')
 when 2 then concat('What happened before ', who, ' left ', city, '?') else question end"""


@query(
    f"""select event_id, case event_id % 4 when 0 then 'who visited ' || lower(city) || '|what hobby'
      when 1 then 'who sold|books also know ' || lower(who) when 2 then lower(who) || ' left ' || lower(city) || '|what happened before ' || lower(who) || ' left ' || lower(city)
      end as parts from {MEMO_SQL}"""
)
def multi_hop_queries(spark, folder):
    m = memo(spark, folder).select("event_id", F.expr(_MULTI_HOP).alias("q"))
    return m.select("event_id", bar(T.decompose_query(F.col("q"))).alias("parts"))


@query()
def prospective_queries(spark, folder):
    c, name = F.col("text"), F.col("name")
    m = memo(spark, folder).select(
        "event_id", "text", "name", T.classify_paragraph(c).alias("kind"),
        T.note_entities(c).alias("entities"), T.extract_keywords(c).alias("keywords"),
    )
    return m.select(
        "event_id",
        bar(T.prospective_queries(c, name, F.col("kind"))).alias("paragraph_queries"),
        bar(T.note_queries(c, name, F.col("entities"), F.col("keywords"))).alias("note_queries"),
    )


#: Python, or Rust for every third part; some functions are longer than a thousand characters
_CODE = """case when p_partkey % 3 = 0 then concat('// Parts of ', p_brand, ' { not a block', chr(10), 'pub struct Part', p_partkey, ' {', chr(10), '    size: u32, // ', p_name, chr(10), '}', chr(10), chr(10),
  'impl Part', p_partkey, ' {', chr(10), '    pub fn size(&self) -> u32 {', chr(10), '        self.size + ', p_size, chr(10), '    }', chr(10), '}')
 else concat('\"\"\"Parts of ', p_brand, '.\"\"\"', chr(10), chr(10), 'def price_', p_partkey, '(x):', chr(10), '    return x * ', p_size,
 repeat(concat(chr(10), '    # def not_', p_size, '(): of a comment'), p_size * 2), chr(10), '    x += 1',
 chr(10), chr(10), 'class Part', p_partkey, ':', chr(10), '    \"\"\"', p_name, '\"\"\"', chr(10), '    def size_of_part(self):', chr(10), '        return ', p_size) end"""


def _code_sql() -> str:
    """The chunks written out, per language."""
    nl = "' || chr(10) || '"
    price = f"'def price_' || p_partkey || '(x):{nl}    return x * ' || p_size || repeat(chr(10) || '    # def not_' || p_size || '(): of a comment', p_size * 2) || '{nl}    x += 1'"
    method = f"'def size_of_part(self):{nl}        return ' || p_size"
    struct = f"'pub struct Part' || p_partkey || ' {{{nl}    size: u32, // ' || p_name || '{nl}}}'"
    impl = f"'impl Part' || p_partkey || ' {{{nl}    pub fn size(&self) -> u32 {{{nl}        self.size + ' || p_size || '{nl}    }}{nl}}}'"
    python = f"""['Parts of ' || p_brand || '.', {price}, 'class Part' || p_partkey || ':{nl}\"\"\"' || trim(p_name) || '\"\"\"', 'class Part' || p_partkey || ':{nl}' || {method}]"""
    return f"""with p as (select p_partkey, case when p_partkey % 3 = 0 then [{struct}, {impl}] else {python} end as c from part)
    select p_partkey, unnest(range(len(c)))::int as pos, unnest(c) as chunk from p"""


@query(_code_sql())
def code_chunks(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.expr(_CODE).alias("code"))
    return parts.select("p_partkey", F.posexplode(split_code("code")).alias("pos", "chunk"))


@query(
    """with p as (select p_partkey, 'Part' || p_partkey as t, 2 * p_size as n from part),
    s as (select p_partkey, unnest(case when p_partkey % 3 = 0 then [{'kind': 'struct', 'name': t, 'owner': null, 'first_line': 2, 'last_line': 4}, {'kind': 'impl', 'name': t, 'owner': null, 'first_line': 6, 'last_line': 10},
        {'kind': 'fn', 'name': 'size', 'owner': t, 'first_line': 7, 'last_line': 9}]
      else [{'kind': 'def', 'name': 'price_' || p_partkey, 'owner': null, 'first_line': 3, 'last_line': 5 + n}, {'kind': 'class', 'name': t, 'owner': null, 'first_line': 7 + n, 'last_line': 10 + n},
        {'kind': 'def', 'name': 'size_of_part', 'owner': t, 'first_line': 9 + n, 'last_line': 10 + n}] end, recursive := true) from p)
    select p_partkey, kind, name, owner, first_line::int as first_line, last_line::int as last_line from s"""
)
def code_symbols(spark, folder):
    """Every definition of the code texts with its owner and lines."""
    parts = table(spark, folder, "part").select("p_partkey", F.expr(_CODE).alias("code"))
    return parts.select("p_partkey", F.inline(code_spans("code")))


@query(
    rf"""with recursive w as (select doc_id, 0 as pos, null::varchar as chunk, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') as rest, 0 as n from documents
      union all select doc_id, n, c, case when whole then [substr(rest[1], 601)] || rest[2:] else rest[len(string_split(c, ' ')) + 1:] end, n + 1 from (
        select doc_id, rest, n, s, case when length(s) <= 600 then s when regexp_matches(substr(s, 1, 600), ' ') then regexp_replace(substr(s, 1, 600), ' [^ ]*$', '') else substr(s, 1, 600) end as c,
          length(s) > 600 and not regexp_matches(substr(s, 1, 600), ' ') and length(rest[1]) > 600 as whole from (select *, array_to_string(rest[1:96], ' ') as s from w where len(rest) > 0)))
    select doc_id, pos, chunk from w where chunk is not null"""
)
def document_chunks(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.text_chunks(F.col("text"))).alias("pos", "chunk"))


_FRONT = """concat('---', chr(10), 'type: ', event_type, chr(10), 'date: ', day, chr(10), 'entities:', chr(10), '  - ', who, chr(10), 'project: ', project, chr(10), '---', chr(10), chr(10), text)"""


@query(f"select event_id, event_type as kind, day as date, project, '' as entities from {MEMO_SQL}")
def frontmatter_fields(spark, folder):
    m = memo(spark, folder).select("event_id", T.frontmatter(F.expr(_FRONT)).alias("f"))
    f = F.col("f")
    return m.select("event_id", f["type"].alias("kind"), f["date"].alias("date"), f["project"].alias("project"),
                    f["entities"].alias("entities"))


@query(
    rf"""with p as (select event_id, {STRIP.format('x')} as p from (select event_id, unnest(string_split(text, chr(10) || chr(10))) as x from {MEMO_SQL}))
    select event_id, p as content from p where length(p) > 50 and {words_sql('lower(p)', fixed.SIGNAL_WORDS)}"""
)
def watched_notes(spark, folder):
    return memo(spark, folder).select("event_id", F.explode(T.watched_paragraphs(F.col("text"))).alias("content"))


