"""Queries for facts, multi-channel retrieval and dated events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import facts as X
from ..operators import temporal as E
from ..plans.scale import top_per_key
from ..session import settle
from .base import MEMO_SQL, memo, query, table
from .text_queries import SIMPLE_ENTITIES_SQL, STRIP, _sentences_sql, chain_sql, q, words_sql

SESSION = "datediff(cast(day as date), date '2024-01-01')"


def turns(spark, folder):
    """One conversation per user, one session per day, one turn per event."""
    m = memo(spark, folder)
    return m.select(
        F.col("user_id").alias("scope"), F.expr(SESSION).alias("session_idx"), F.col("event_id").alias("turn_idx"),
        F.lit("user").alias("role"), F.col("body").alias("text"), F.col("day").alias("session_date"),
    )


def questions(spark, folder):
    return memo(spark, folder).select(
        F.col("user_id").alias("scope"), F.col("event_id").alias("query_id"), "question",
        F.lit("2024-01-20").alias("reference_date"),
        F.expr("split_part('temporal-reasoning,multi-session,knowledge-update,single-session-preference,single-session-user', ',', cast(1 + event_id % 5 as int))").alias("qtype"),
    )


def facts_table(spark, folder):
    """Facts as a stored table: they are read several times by every retrieval."""
    return settle(X.decompose(turns(spark, folder)))


def windows(spark, folder):
    return settle(X.close_windows(facts_table(spark, folder)))


FACTS_SQL = rf"""s as (select user_id as scope, datediff('day', date '2024-01-01', cast(day as date)) as session_idx, event_id, day,
      unnest({_sentences_sql('body')}) as text, generate_subscripts({_sentences_sql('body')}, 1) - 1 as pos from {MEMO_SQL}),
    f0 as (select scope, session_idx * 8796093022208 + event_id * 65536 + pos as fact_idx, session_idx, day, {STRIP.format('text')} as text from s where length({STRIP.format('text')}) >= 10),
    f1 as (select *, {chain_sql([(n, f"regexp_matches(text, '(?i){q(p)}')") for n, p in fixed.FACT_CLASSES], 'event')} as fact_type,
      regexp_matches(text, '(?i){q(fixed.CHANGE_VERBS)}') as supersedes, list_transform({SIMPLE_ENTITIES_SQL.format('text')}, lambda x: lower(x)) as ents,
      regexp_extract_all(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b') as dates from f0),
    f as (select *, coalesce(dates[1], '') as valid_from, len(dates) > 0 as dated from f1),
    st as (select distinct scope, fact_idx, session_idx, valid_from, unnest(ents) as entity from f where fact_type = 'state' and supersedes),
    nx as (select scope, fact_idx, lead(fact_idx) over w as n_idx, lead(valid_from) over w as n_from, lead(session_idx) over w as n_sess from st
      window w as (partition by scope, entity order by fact_idx)),
    cl as (select scope, fact_idx, min_by(case when n_from <> '' then n_from else 'before-session-' || n_sess end, n_idx) as valid_until from nx where n_idx is not null group by 1, 2),
    facts as (select f.*, coalesce(valid_until, '') as valid_until from f left join cl using (scope, fact_idx))"""

_W3 = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{3,}}'))"
MATCH_SQL = rf"""qs as (select user_id as scope, event_id as query_id, question from {MEMO_SQL}),
    qk as (select scope, query_id, unnest({_W3.format('question')}) as k, 1 as p from qs
      union all select scope, query_id, unnest(list_transform({SIMPLE_ENTITIES_SQL.format('question')}, lambda x: lower(x))), 3 from qs),
    fk as (select scope, fact_idx, unnest({_W3.format('text')}) as k, 1 as p from facts union all select scope, fact_idx, unnest(ents), 3 from facts),
    m as (select query_id, scope, fact_idx, sum(p)::double as score from qk join fk using (scope, k, p) group by 1, 2, 3)"""


@query(f"with {FACTS_SQL} select scope, fact_idx, fact_type, valid_from, valid_until from facts")
def supersession_windows(spark, folder):
    return windows(spark, folder).select("scope", "fact_idx", "fact_type", "valid_from", "valid_until")


_RANK = "row_number() over (partition by query_id order by round(score, 9) desc, fact_idx)"
QUERY_SQL = f"""qf as (select query_id, fact_idx, scope, m.score + case when {words_sql('lower(question)', fixed.UPDATE_WORDS)} then session_idx * 2.0 + case when supersedes then 5 else 0 end else 0 end as score
      from m join facts using (scope, fact_idx) join qs using (query_id, scope) where {{0}})"""


@query(
    f"""with {FACTS_SQL}, {MATCH_SQL}, {QUERY_SQL.format("not coalesce(try_cast(valid_until as date) < date '2024-01-20', false)")},
    r as (select *, {_RANK} as rank from qf) select query_id, fact_idx, score, score * 0.5 as weighted, rank from r where rank <= 10"""
)
def fact_query(spark, folder):
    return X.query_facts(windows(spark, folder), questions(spark, folder), 10).select(
        "query_id", "fact_idx", "score", "weighted", "rank"
    )


TEMPORAL_SQL = f"""tf as (select query_id, fact_idx, m.score + case when dated then 5 else 0 end + case when valid_from <> '' then 2 else 0 end as score, 0 as extra
      from m join facts using (scope, fact_idx) union all
      select query_id, fact_idx, 2.0, 1 from qs join facts using (scope) where dated and {words_sql('lower(question)', fixed.ORDERING_WORDS)}
        and not exists (select 1 from m where m.query_id = qs.query_id and m.fact_idx = facts.fact_idx))"""


@query(
    f"""with {FACTS_SQL}, {MATCH_SQL}, {TEMPORAL_SQL},
    r as (select *, row_number() over (partition by query_id order by score desc, extra, fact_idx) as rank from tf)
    select query_id, fact_idx, score, rank from r where rank <= 10"""
)
def temporal_fact_query(spark, folder):
    found = X.temporal_facts(facts_table(spark, folder), questions(spark, folder), 10)
    return found.select("query_id", "fact_idx", "score", "rank")


SESSION_SQL = f"""ch as (select m.*, session_idx, {_RANK} as before from m join facts using (scope, fact_idx)),
    ct as (select * from ch where before <= {{0}}),
    cs as (select query_id, fact_idx, session_idx, before, score + case when row_number() over (partition by query_id, session_idx order by before) = 1 then 3 else 0 end as score from ct)"""


@query(
    f"""with {FACTS_SQL}, {MATCH_SQL}, {SESSION_SQL.format(10)}
    select query_id, fact_idx, session_idx, score, row_number() over (partition by query_id order by score desc, before) as rank from cs"""
)
def cross_session_query(spark, folder):
    found = X.cross_session_facts(facts_table(spark, folder), questions(spark, folder), 10)
    return found.select("query_id", "fact_idx", "session_idx", "score", "rank")


@query(
    f"""with {FACTS_SQL}, {MATCH_SQL}, {QUERY_SQL.format('true')}, {TEMPORAL_SQL}, {SESSION_SQL.format(20)},
    b as (select query_id, fact_idx, {_RANK} as rank from qf),
    t as (select query_id, fact_idx, row_number() over (partition by query_id order by score desc, extra, fact_idx) as rank from tf),
    c as (select query_id, fact_idx, row_number() over (partition by query_id order by score desc, before) as rank from cs),
    u as (select query_id, fact_idx, rank, 2.0 / (59 + rank) as part from b where rank <= 20
      union all select query_id, fact_idx, rank, 1.0 / (59 + rank) from t where rank <= 20 and query_id % 5 in (0, 2)
      union all select query_id, fact_idx, rank, 2.0 / (59 + rank) from c where rank <= 20 and query_id % 5 = 1),
    g as (select query_id, text, sum(part) as rrf, min_by(u.fact_idx, (rank, u.fact_idx)) as fact_idx from u join qs using (query_id) join facts using (scope, fact_idx) group by 1, 2),
    w as (select g.query_id, g.fact_idx, rrf * case when coalesce(try_cast(nullif(valid_from, '') as date), cast(day as date)) < date '2024-01-20'
        then pow(2.0, -datediff('day', coalesce(try_cast(nullif(valid_from, '') as date), cast(day as date)), date '2024-01-20') / 30.0) else 1 end as score
      from g join qs using (query_id) join facts using (scope, fact_idx)),
    r as (select *, {_RANK} as rank from w) select query_id, fact_idx, round(score, 8) as score, rank from r where rank <= 10"""
)
def channel_fusion(spark, folder):
    found = X.fused_ranks(windows(spark, folder), questions(spark, folder), 10)
    return found.select("query_id", "fact_idx", F.round("score", 8).alias("score"), "rank")


@query()
def sufficiency_loop(spark, folder):
    """Fusion with rewording of questions that found too little."""
    found = X.retrieve(windows(spark, folder), questions(spark, folder), 5)
    return found.select("query_id", "fact_idx", F.round("score", 8).alias("score"), "rank")


@query(
    f"""with {FACTS_SQL} select scope, fact_idx, valid_from <> '' as dated, row_number() over (partition by scope order by valid_from, fact_idx) as pos
    from facts where valid_from <> '' qualify pos <= 20"""
)
def chronological_facts(spark, folder):
    facts = X.decompose(turns(spark, folder)).where("valid_from <> ''")
    top = top_per_key(facts, ["scope"], [*X.chronological(facts)[:1], F.asc("fact_idx")], 20, "pos")
    return top.select("scope", "fact_idx", (F.col("valid_from") != "").alias("dated"), "pos")


# ---- dated events -----------------------------------------------------------------------------


def order_events(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").cast("string").alias("date"),
        F.concat(F.lit("order "), "o_orderstatus", F.lit(" priority "), "o_orderpriority", F.lit(" customer c"), "o_custkey").alias("text"),
    )


ORDERS_SQL = """o as (select o_orderkey as event_id, cast(cast(o_orderdate as date) as string) as date,
    'order ' || o_orderstatus || ' priority ' || o_orderpriority || ' customer c' || o_custkey as text from orders)"""


@query(
    f"""with {ORDERS_SQL}, f as (select date, min(event_id) as src from o group by 1), d as (select date, lead(date) over (order by date) as nxt from f),
    h as (select event_id, date, row_number() over (partition by date order by event_id) as rn from o)
    select src, event_id as dst, 'same_day' as relation, o.date as src_date, o.date as dst_date from o join f using (date) where event_id <> src
    union all select a.event_id, b.event_id, 'before', a.date, b.date from h a join d on a.date = d.date join h b on b.date = d.nxt where a.rn <= 3 and b.rn <= 3"""
)
def temporal_edges(spark, folder):
    return E.date_edges(order_events(spark, folder))


@query(
    f"""with {ORDERS_SQL} select event_id, date, 'between' as kind from o where date between '1996-03-01' and '1996-05-31'
    union all select event_id, date, 'on' from o where date = '1997-07-07'"""
)
def events_between(spark, folder):
    o = order_events(spark, folder)
    between = o.where(F.col("date").between("1996-03-01", "1996-05-31")).withColumn("kind", F.lit("between"))
    on = o.where("date = '1997-07-07'").withColumn("kind", F.lit("on"))
    return between.unionByName(on).select("event_id", "date", "kind")


@query(
    f"""with {ORDERS_SQL}, r as (select event_id, date, cos(2 * pi() * dayofyear(cast(date as date)) / 365.25 - 2 * pi() * dayofyear(date '2024-03-01') / 365.25) as r from o)
    select event_id, date, round(r, 9) as resonance from r where r >= 0.99"""
)
def resonance_search(spark, folder):
    found = E.resonance(order_events(spark, folder), F.lit("2024-03-01").cast("date"))
    return found.select("event_id", "date", F.round("resonance", 9).alias("resonance"))


_EVENT_ASK = """case n_nationkey % 4 when 0 then 'which urgent order came after 1996-06-01' when 1 then concat('latest order of customer c', n_nationkey * 7 + 1)
 when 2 then concat('first order F before 1995-01-0', 1 + n_nationkey % 9) else 'order high priority between 1995-02-01 and 1995-02-20' end"""


@query(
    f"""with {ORDERS_SQL}, qs as (select n_nationkey as query_id, {_EVENT_ASK} as query from nation),
    ds as (select *, list_sort(list_distinct(regexp_extract_all(query, '\\d{{4}}-\\d{{2}}-\\d{{2}}'))) as d, contains(query, 'after') as aft, contains(query, 'before') as bef from qs),
    t as (select event_id, date, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) as t from o),
    j as (select query_id, query, d, event_id, date, len(list_intersect(t, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}')))) as overlap from ds, t
      where case when len(d) = 0 then true when aft then date >= d[1] when bef then date <= d[1] when len(d) >= 2 then date between d[1] and d[2] else true end),
    r as (select *, row_number() over (partition by query_id order by case when contains(query, 'latest') then date end desc, case when contains(query, 'first') then date end, overlap desc, event_id) as rank
      from j where overlap > 0 or len(d) > 0)
    select query_id, event_id, date, overlap, rank from r where rank <= 5"""
)
def temporal_query(spark, folder):
    asked = table(spark, folder, "nation").select(F.col("n_nationkey").alias("query_id"), F.expr(_EVENT_ASK).alias("query"))
    return E.query_events(order_events(spark, folder), asked, F.lit("2024-01-31").cast("date"), 5)


@query(
    f"""select name as source, count(*) as n_events, count(distinct d) as n_dates from (
      select name, unnest(list_distinct(list_concat(regexp_extract_all(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}'),
        case when regexp_matches(x, 'Yesterday') then [cast(cast(day as date) - 1 as string)] else [] end,
        case when regexp_matches(x, '2 weeks after \\d') then [cast(cast(day as date) + 14 as string)] else [] end,
        case when regexp_matches(x, '3 days before \\d') then [cast(cast(day as date) - 3 as string)] else [] end))) as d
      from (select name, day, unnest(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as x from {MEMO_SQL})) group by 1"""
)
def event_extraction(spark, folder):
    docs = memo(spark, folder).select("name", F.col("body").alias("text"), "day")
    found = E.extract_events(docs, F.to_date("day"))
    return found.groupBy("source").agg(F.count("*").alias("n_events"), F.count_distinct("date").alias("n_dates"))


def _answers(spark, folder, text: str):
    """Per customer: all orders as dated events in the order of their keys, and one question."""
    o = table(spark, folder, "orders")
    text_ = F.concat(F.lit("placed an order with priority "), F.lower("o_orderpriority"))
    dated = o.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("date"), text_.alias("text"))
    per = dated.groupBy("o_custkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "date", "text"))), lambda x: F.struct(x["date"].alias("date"), x["text"].alias("text"))).alias("events")
    )
    return per.select("o_custkey", E.temporal_answer(F.lit(text), F.col("events"), F.lit("2000-01-01").cast("date")).alias("answer"))


_DATED = """f as (select o_custkey, o_orderkey, cast(o_orderdate as date) as d, 'placed an order with priority ' || lower(o_orderpriority) as text,
    row_number() over (partition by o_custkey order by o_orderkey) as rn from orders)"""


@query(
    f"""with {_DATED}, l as (select o_custkey, arg_max(text, (d, -rn)) as text, max(d) as d from f group by 1)
    select o_custkey, substr(text, 1, 100) || ' (' || cast(d as string) || ')' as answer from l"""
)
def most_recent_event(spark, folder):
    return _answers(spark, folder, "What was the most recent purchase?")


@query(
    f"""with {_DATED} select o_custkey, count(distinct d) || ' times (on ' || string_agg(distinct cast(d as string), ', ' order by cast(d as string)) || ')' as answer from f group by 1"""
)
def distinct_days(spark, folder):
    return _answers(spark, folder, "How many times did they place an order?")


@query(
    f"""with {_DATED}, l as (select o_custkey, arg_max(text, (d, -rn)) as text, max(d) as d from f group by 1)
    select o_custkey, ((2000 - year(d)) * 12 + 1 - month(d)) || ' months (' || datediff('day', d, date '2000-01-01') || ' days, or ' || (datediff('day', d, date '2000-01-01') + 1)
      || ' inclusive) since ' || substr(text, 1, 60) || ' (' || cast(d as string) || ')' as answer from l"""
)
def months_since(spark, folder):
    return _answers(spark, folder, "Months since their shopping?")


@query()
def duration_between(spark, folder):
    return _answers(spark, folder, "How many weeks between the urgent order and the high priority one?")


