"""Queries for answer extraction, comparison, signals, redaction and numeric facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import fixed
from ..functions import text as T
from ..functions.common import spans
from ..operators.precompute import dominant_sum
from .base import MEMO_SQL, memo, query, table
from .text_queries import STRIP, bar, chain_sql, q

_QT = chain_sql([(n, f"regexp_matches(lower(question), '{q(p)}')") for n, p in fixed.QUESTION_TYPES], "generic")


@query(f"select event_id, {_QT} as qtype from {MEMO_SQL}")
def question_types(spark, folder):
    return memo(spark, folder).select("event_id", A.question_type(F.col("question")).alias("qtype"))


_W3 = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{3,}}'))"


@query(
    rf"""with s as (select event_id, {_W3.format('question')} as qt, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as s,
      generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) as i from {MEMO_SQL}),
    o as (select event_id, s, i, len(list_intersect(qt, {_W3.format('s')})) as n from s)
    select event_id, case when max(n) > 0 then arg_max(s, (n, -i)) end as sentence from o group by 1"""
)
def best_sentence(spark, folder):
    return memo(spark, folder).select("event_id", A.best_sentence(F.col("question"), F.col("text")).alias("sentence"))


@query(
    rf"""select event_id, nullif(regexp_extract(text, 'v\d+\.\d+(?:\.\d+)?'), '') as version, nullif(regexp_extract(text, '\d+\.?\d*%'), '') as percentage,
      list_filter(regexp_extract_all(body, '\b\d[\d,]*(?:\.\d+)?\b'), lambda x: not regexp_full_match(x, '20\d\d'))[1] as number, day as first_date from {MEMO_SQL}"""
)
def first_values(spark, folder):
    t = F.col("text")
    return memo(spark, folder).select(
        "event_id", A.version_answer(t).alias("version"), A.percentage_answer(t).alias("percentage"),
        A.number_answer(F.col("body")).alias("number"), A.date_answer(t).alias("first_date"),
    )


def _near(cands: str) -> str:
    """First candidate struct(t, p) with the most query words within 80 characters."""
    return f"""list_sort(list_transform({cands}, lambda c, i: {{'n': -len(list_filter(qt, lambda t: contains(lower(substr(body, greatest(c.p - 80, 0) + 1, c.p + length(c.t) + 80 - greatest(c.p - 80, 0))), t))), 'i': i, 't': c.t}}))[1].t"""


_POS = r"""list_filter(list_transform(range(1, length(body) + 1), lambda p: {{'t': regexp_extract(substr(body, p), '^(?:{0})'), 'p': p - 1, 'b': substr(body, p - 1, 1)}}),
   lambda c: c.t <> '' and {1})"""


@query(
    rf"""with m as (select event_id, body, {_W3.format('question')} as qt, question from {MEMO_SQL}),
    k as (select event_id, {_near(_POS.format('[0-9]{4}-[0-9]{2}-[0-9]{2}', "not regexp_matches(c.b, '[0-9]')"))} as date_answer,
      {_near(_POS.format('[A-Z][a-z]+(?:[ ]+[A-Z][a-z]+)+', "not (c.p > 0 and regexp_matches(c.b, '[A-Za-z]')) and not (c.p > 1 and regexp_matches(substr(body, greatest(c.p - 12, 1), least(c.p, 13)), '(?:^|[^A-Za-z])[A-Z][a-z]+ +$'))"))} as name_answer from m)
    select * from k"""
)
def nearest_answers(spark, folder):
    t, q_ = F.col("body"), F.col("question")
    full = F.when(F.size(spans(t, A.FULL_NAME)) > 0, A.name_answer(t, q_))
    return memo(spark, folder).select("event_id", A.date_answer(t, q_).alias("date_answer"), full.alias("name_answer"))


@query(
    rf"""with m as (select event_id, lower(body) as t, list_distinct(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]{{3,}}')) as qt from {MEMO_SQL}),
    v as (select event_id, list_transform(list_filter(qt, lambda w: contains(t, w)), lambda w: case when len(list_filter([{",".join("'" + q(x) + "'" for x in fixed.NEGATION_MARKERS)}],
      lambda n: contains(substr(t, greatest(strpos(t, w) - 41, 0) + 1, strpos(t, w) + 39 - greatest(strpos(t, w) - 41, 0)), n))) > 0 then 1 else -1 end) as v from m)
    select event_id, case when coalesce(list_sum(v), 0) > 0 then 'No' else 'Yes' end as answer from v"""
)
def yes_no_answers(spark, folder):
    return memo(spark, folder).select("event_id", A.yes_no_answer(F.col("body"), F.col("question")).alias("answer"))


#: two dated order events in one text per customer, with a duration question
_SPAN = """concat('The first parcel came on ', cast(cast(o_orderdate as date) as string), ' in spring. Later the refund for it was booked on ',
  cast(cast(o_orderdate as date) + cast(7 + o_orderkey % 50 as int) as string), ' by mail.')"""


@query(
    """with o as (select o_orderkey, cast(o_orderdate as date) as a, cast(7 + o_orderkey % 50 as int) as n from orders)
    select o_orderkey, n || ' days (or ' || (n + 1) || ' days counting both endpoints)' as in_days, (n // 7) || ' weeks (' || n || ' days exclusive, ' || (n + 1) || ' inclusive)' as in_weeks,
      ((year(a + n) - year(a)) * 12 + month(a + n) - month(a)) || ' months (' || n || ' days exclusive, ' || (n + 1) || ' inclusive)' as in_months from o"""
)
def duration_answers(spark, folder):
    t = F.col("t")
    o = table(spark, folder, "orders").select("o_orderkey", F.expr(_SPAN).alias("t")).select("o_orderkey", "t", A.iso_days(t).alias("days"))
    ask = lambda u: A.duration_answer(t, F.lit(f"How many {u} between the first parcel and the refund?"), F.col("days"))
    return o.select("o_orderkey", ask("days").alias("in_days"), ask("weeks").alias("in_weeks"), ask("months").alias("in_months"))


@query()
def extracted_answers(spark, folder):
    return memo(spark, folder).select("event_id", A.extract_answer(F.col("question"), F.col("body")).alias("answer"))


@query()
def answer_candidates(spark, folder):
    rows = memo(spark, folder).select("event_id", F.inline(A.answer_candidates(F.col("question"), F.col("body"))))
    return rows.select("event_id", "answer", "type", F.round("score", 6).alias("score"))


_PRED = """case p_partkey % 6 when 0 then concat('Likely yes, because ', p_brand, ' is fine') when 1 then concat('I think ', p_name, ' and ', p_brand, '.')
  when 2 then 'No, since it was never sold' when 3 then concat(p_type, ', ', p_brand, ', and ', p_name) when 4 then '' else concat(p_brand, '; however it varies') end"""
_TRUTH = """case p_partkey % 5 when 0 then 'Yes' when 1 then concat(p_brand, ', pottery, ', p_name, ', swimming') when 2 then 'Likely no' when 3 then p_brand else concat('camping or ', p_type) end"""

_NORM = rf"""(case when regexp_matches({{0}}, '{fixed.ANSWER_YES}') then lower(regexp_extract({{0}}, '{fixed.ANSWER_YES}')) when regexp_matches({{0}}, '{fixed.ANSWER_NO}') then lower(regexp_extract({{0}}, '{fixed.ANSWER_NO}'))
   else lower(trim(regexp_replace(trim(regexp_replace({{0}}, '(?s){fixed.ANSWER_EXPLANATION}.*$', '')), '\.$', ''))) end)"""
_DEHEDGE = "trim(regexp_replace(trim({0}), '" + fixed.ANSWER_HEDGE + "', ''))"
_ITEMS = r"list_distinct(list_filter(list_transform(string_split_regex({0}, '\s*,\s+(?:and\s+)?|\s*,\s*|\s+and\s+|\s+or\s+'), lambda x: trim(x)), lambda x: x <> ''))"


@query(
    rf"""with a as (select p_partkey, {_PRED} as p, {_TRUTH} as g from part),
    h as (select p_partkey, {_DEHEDGE.format('p')} as p, {_DEHEDGE.format('g')} as g from a),
    n as (select p_partkey, {_NORM.format('p')} as p, {_NORM.format('g')} as g from h),
    f as (select *, regexp_matches(p, '{fixed.ANSWER_YES}') as py, regexp_matches(p, '{fixed.ANSWER_NO}') as pn, regexp_matches(g, '{fixed.ANSWER_YES}') as gy, regexp_matches(g, '{fixed.ANSWER_NO}') as gn,
      len(list_intersect({_ITEMS.format('p')}, {_ITEMS.format('g')})) as c, len({_ITEMS.format('g')}) as m from n)
    select p_partkey, p as normal, case when p = '' or g = '' then false when p = g or contains(g, p) or contains(p, g) then true when (py and gy) or (pn and gn) then true
      when (py and gn) or (pn and gy) then false else c > 0 and c / greatest(m, 1) >= 0.25 end as same from f"""
)
def answers_match(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.expr(_PRED).alias("p"), F.expr(_TRUTH).alias("g"))
    return p.select(
        "p_partkey", A.normalize_answer(F.col("p")).alias("normal"), A.answers_match(F.col("p"), F.col("g")).alias("same")
    )


@query()
def fuzzy_answers(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("p"), F.concat("p_name", F.lit(" "), F.substring("p_brand", 1, 4)).alias("g"), "p_type")
    return p.select(
        "p_partkey", A.fuzzy_match(F.col("p"), F.col("g")).alias("near"), A.fuzzy_match(F.col("p"), F.col("p_type")).alias("far"),
        F.round(A.lexical_similarity(F.col("p"), F.col("p_type")), 9).alias("similarity"),
    )


@query(
    """with n as (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as int) as n from lineitem)
    select l_orderkey, l_linenumber, case l_partkey % 4 when 0 then n::string when 1 then '1' || lpad(n::string, 3, '0')
      when 2 then case when n < 20 then (n)::string else (n // 10 * 10 + n % 10)::string end else '2000' end as number from n"""
)
def number_words(spark, folder):
    tens = "split_part('zero,ten,twenty,thirty,forty,fifty', ',', cast(1 + floor(n / 10) as int))"
    ones = "split_part('zero,one,two,three,four,five,six,seven,eight,nine,ten,eleven,twelve,thirteen,fourteen,fifteen,sixteen,seventeen,eighteen,nineteen', ',', cast(1 + n % 20 as int))"
    one = "split_part('zero,one,two,three,four,five,six,seven,eight,nine', ',', cast(1 + n % 10 as int))"
    text = f"""case l_partkey % 4 when 0 then concat(cast(n as string), '%') when 1 then concat('1,', lpad(cast(n as string), 3, '0'))
      when 2 then case when n < 20 then {ones} when n % 10 = 0 then {tens} else concat({tens}, '-', {one}) end else 'two thousand and then some' end"""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("n"))
    return rows.select("l_orderkey", "l_linenumber", A.normalize_number(F.expr(text)).alias("number"))


_RATED = "concat(body, case when event_id % 4 = 0 then concat(chr(10), 'CONFIDENCE: ', case when event_id % 8 = 0 then '0.5' else '1.7' end) else '' end)"


@query(
    rf"""select event_id, {STRIP.format('body')} as answer, case when event_id % 4 = 0 then case when event_id % 8 = 0 then 0.5 else 1.0 end end::double as confidence,
      round(1 / (1 + exp(-greatest(-60, least(60, value - 20)))), 9) as calibrated, len(regexp_extract_all(body, '\S+')) as tokens, sha256(body) as prompt_hash from {MEMO_SQL}"""
)
def rated_answers(spark, folder):
    c = F.col("c")
    m = memo(spark, folder).select("event_id", A.split_confidence(F.expr(_RATED)).alias("c"), "value", "body")
    return m.select(
        "event_id", c["answer"].alias("answer"), c["confidence"].alias("confidence"),
        F.round(A.logistic(F.col("value") - 20), 9).alias("calibrated"), T.token_estimate(F.col("body")).alias("tokens"),
        F.sha2("body", 256).alias("prompt_hash"),
    )


_RULES = [("correction", p, w) for p, w in fixed.CORRECTION_SIGNALS] + [("reinforcement", p, w) for p, w in fixed.REINFORCEMENT_SIGNALS]


@query(
    "with s as (select event_id, lower(body) as t from " + MEMO_SQL + "), r as (" + " union all ".join(
        f"select event_id, {i} as i, '{k}' as signal, {w}::double as confidence from s where regexp_matches(t, '{q(p)}')" for i, (k, p, w) in enumerate(_RULES)
    ) + ") select event_id, signal, confidence, (row_number() over (partition by event_id order by confidence desc, i) - 1)::int as pos from r"
)
def message_signals(spark, folder):
    rows = memo(spark, folder).select("event_id", F.posexplode(A.detect_signals(F.col("body"))).alias("pos", "s"))
    return rows.select("event_id", F.col("s.signal").alias("signal"), F.col("s.confidence").alias("confidence"), "pos")


@query(
    "with s as (select event_id, lower(body) as t from " + MEMO_SQL + ") select event_id, " + chain_sql(
        [(k, f"regexp_matches(t, '{q(p)}')") for k, p, _ in sorted(_RULES, key=lambda r: (-r[2], r[0] != "correction"))], "neutral"
    ) + " as kind from s"
)
def message_classes(spark, folder):
    return memo(spark, folder).select("event_id", A.message_class(F.col("body")).alias("kind"))


@query(
    rf"""with s as (select event_id, {STRIP.format('x')} as s from (select event_id, unnest(string_split_regex(text, '[.!?\n]')) as x from {MEMO_SQL}))
    select event_id, count(*) as n, min(s) as first_point from s where length(s) >= 15 and regexp_matches(s, '(?i){"|".join(fixed.DECISION_POINTS)}') group by 1"""
)
def decision_points(spark, folder):
    rows = memo(spark, folder).select("event_id", F.explode(A.decision_points(F.col("text"))).alias("s"))
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), F.min("s").alias("first_point"))


@query(
    rf"""with p as (select event_id, n, length(text) as len, lower(who) || '.x@example.com' as mail, '555-010-' || (1000 + n) as phone, text from {MEMO_SQL})
    select event_id, replace(replace(text, mail, '[REDACTED:EMAIL]'), phone, '[REDACTED:PHONE]') as redacted, 1 as emails, 1 as phones from p"""
)
def memo_redaction(spark, folder):
    r = F.col("r")
    m = memo(spark, folder).select("event_id", A.redact(F.col("text")).alias("r"))
    return m.select("event_id", r["text"].alias("redacted"), r["counts"]["EMAIL"].alias("emails"), r["counts"]["PHONE"].alias("phones"))


@query()
def document_redaction(spark, folder):
    """Whole documents: digest of the redacted text and the number of hits per tag."""
    r = F.col("r")
    d = table(spark, folder, "documents").select("doc_id", A.redact(F.col("text")).alias("r"))
    entries = F.array_sort(F.map_entries(r["counts"]))
    shown = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return d.select("doc_id", F.md5(r["text"]).alias("digest"), bar(shown).alias("counts"))


@query(
    rf"""select event_id, array_to_string(list_sort(list_concat(case when event_type = 'purchase' then ['Books|' || n || '|pages', '(unlabelled)|' || n || '|CHF'] else [] end, [])), ';') as facts
    from {MEMO_SQL} where event_type = 'purchase'"""
)
def numeric_facts(spark, folder):
    shown = F.transform(
        A.numeric_facts(F.col("body")),
        lambda x: F.concat_ws("|", F.regexp_replace(x["label"], "^.* ", ""), F.floor(x["value"]).cast("string"), x["unit"]),
    )
    m = memo(spark, folder).where("event_type = 'purchase'")
    return m.select("event_id", F.array_join(F.array_sort(shown), ";").alias("facts"))


#: one text per order line with quantities of several units
@query(
    """with l as (select l_orderkey, l_linenumber, cast(l_quantity as int) as v, case when l_returnflag = 'R' then 'hours' else 'pages' end as unit from lineitem),
    u as (select l_orderkey, unit, sum(v) as total, count(*) as n, min(l_linenumber) as first from l group by 1, 2),
    d as (select *, row_number() over (partition by l_orderkey order by n desc, first, unit) as rn from u)
    select l_orderkey, unit, total::double as total, n from d where rn = 1 and n >= 2"""
)
def sum_by_unit(spark, folder):
    """Total of the most frequent unit per order, read from the text of its lines."""
    line = F.concat(F.lit("Reader Club took "), F.col("l_quantity").cast("int"), F.lit(" "), F.when(F.col("l_returnflag") == "R", "hours").otherwise("pages"), F.lit("."))
    facts = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.inline(A.numeric_facts(line)))
    return dominant_sum(facts.withColumnRenamed("l_linenumber", "pos"), "l_orderkey")


@query(
    """with l as (select l_orderkey, p_brand from lineitem join part on p_partkey = l_partkey)
    select l_orderkey, count(distinct lower(p_brand)) as n from l group by 1 having count(distinct lower(p_brand)) >= 2"""
)
def count_distinct_items(spark, folder):
    """Distinct brands per order, read from list sentences."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey")
    text = F.concat(F.lit("Different brands: the "), "p_brand", F.lit(", and "), F.upper("p_brand"), F.lit("."))
    items = lines.select(
        "l_orderkey", F.explode(A.count_facts(F.lit("How many different brands did they order?"), text)).alias("label")
    )
    per = items.select("l_orderkey", F.lower("label").alias("label")).distinct().groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return per.where("n >= 2")


@query(
    r"""select p_partkey, case when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b)) / greatest(len(a), len(b)) end::double as share from (
      select p_partkey, list_distinct(regexp_extract_all(p_name, '[\p{L}\p{N}_]{3,}')) as a, list_distinct(regexp_extract_all(p_name || ' ' || p_type, '[\p{L}\p{N}_]{3,}')) as b from part)"""
)
def token_overlap(spark, folder):
    p = table(spark, folder, "part")
    return p.select("p_partkey", T.token_overlap(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")).alias("share"))
