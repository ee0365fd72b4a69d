"""Queries for feeds, ledgers, calibration, metrics and reader contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import context as X
from ..operators import facts as K
from ..operators import ledger as L
from ..operators import metrics as M
from ..session import settle
from .base import MEMO_SQL, memo, query, table
from .fact_queries import FACTS_SQL, questions, turns, windows
from .text_queries import bar

# ---- feeds and writes ---------------------------------------------------------------------------------

_FEED = {
    "line_no": "event_id + 1",
    "ty": "case event_id % 5 when 0 then 'finding' when 1 then 'decision-point' when 2 then 'chat' when 3 then 'chat' else 'presence' end",
    "s": "case event_id % 3 when 0 then concat(project, '/worker-7f3a') when 1 then concat('presence@', project) else concat(project, ' x/Reviewer') end",
    "t": "case event_id % 4 when 0 then cast(1700000000 + event_id as string) when 1 then cast(1700000000000 + event_id as string) when 2 then concat(day, 'T10:00:00Z') else 'soon' end",
    "p": "case event_id % 6 when 0 then concat('Decision: keep ', city) when 1 then concat('[Key Finding]: ', body) when 2 then body when 3 then '' else concat(' finding : ', who, ' ') end",
    "h": "case when event_id % 7 = 0 then '' else concat('Host ', event_id % 11) end",
}


def feed(spark, folder):
    return memo(spark, folder).selectExpr(*[f"{e} as {c}" for c, e in _FEED.items()])


FEED_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in _FEED.items()) + f" from {MEMO_SQL}"


@query(
    rf"""with f as ({FEED_SQL}), k as (select *, replace(ty, '-', '_') as kind, regexp_matches(p, '(?i)^\s*(?:\[(finding|key finding|decision|decision point)\]|(finding|key finding|decision|decision point))\s*:\s*(.+?)\s*$') as m,
      trim(regexp_extract(p, '(?is)^\s*(?:\[(?:finding|key finding|decision|decision point)\]|(?:finding|key finding|decision|decision point))\s*:\s*(.+?)\s*$', 1)) as st,
      lower(regexp_extract(p, '(?i)^\s*\[?(finding|key finding|decision|decision point)', 1)) as lab from f),
    r as (select line_no, case when m then st when kind in ('finding', 'decision_point') then trim(p) end as statement,
      case when m then case when contains(lab, 'decision') then 'decision' else 'outcome' end when kind = 'finding' then 'outcome' else 'decision' end as subkind,
      case when (line_no - 1) % 3 = 0 then upper(split_part(s, '/', 1)) when (line_no - 1) % 3 = 1 then upper(split_part(s, '@', 2)) else replace(upper(split_part(s, '/', 1)), ' ', '-') end as project,
      case (line_no - 1) % 3 when 0 then 'worker' when 1 then 'system' else 'reviewer' end as actor,
      case (line_no - 1) % 4 when 0 then t::double when 1 then t::double / 1000 when 2 then epoch(cast(replace(replace(t, 'T', ' '), 'Z', '') as timestamp)) else 0 end::double as ts,
      case when h = '' then 'feed-line-' || line_no else replace(lower(h), ' ', '-') end as session from k)
    select * from r where statement <> ''"""
)
def feed_findings(spark, folder):
    p = F.col("provenance")
    return L.feed_findings(feed(spark, folder)).select(
        "line_no", "statement", "subkind", p["project"].alias("project"), p["actor"].alias("actor"), p["ts"].alias("ts"), p["session"].alias("session")
    )


@query(
    """select event_id, case when event_id % 10 = 3 and event_id % 7 = 1 then 'falsified evidence marked reference-validated' end as rejection,
      case event_type when 'error' then 'outcome' else 'decision' end || '-' || substr(sha256(props), 1, 16) || '.md' as path from events"""
)
def finding_admission(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.expr("case when event_id % 10 = 3 then 'Falsified' else 'measured' end").alias("evidence_kind"),
        F.expr("case when event_id % 7 = 1 then 'reference_validated' else 'roadmap' end").alias("claim_status"),
        F.expr("case event_type when 'error' then 'Outcome' else 'decision' end").alias("subkind"), "props",
    )
    return L.admit(e).select("event_id", "rejection", L.finding_path(F.col("subkind"), F.col("props")).alias("path"))


_WRITE = {
    "event_id": "event_id",
    "content": "case event_id % 9 when 0 then '' when 1 then 'too short' else body end", "project": "case when event_id % 5 = 0 then '' else project end",
    "actor": "case when event_id % 8 = 0 then '' else concat(project, '/', lower(who)) end", "timestamp": "case when event_id % 7 = 0 then 'never' else cast(1700000000 + event_id as string) end",
}


def writes(spark, folder):
    return memo(spark, folder).selectExpr(*[f"{e} as {c}" for c, e in _WRITE.items()]).withColumn("entities", F.array(F.lit("x")))


WRITE_SQL = f"""w as (select {", ".join(f"{e} as {c}" for c, e in _WRITE.items())} from {MEMO_SQL}),
    v as (select event_id, content, project, actor, list_filter([case when content = '' then 'missing_content' when length(content) < 15 then 'content_too_short' end, case when project = '' then 'missing_project' end,
      case when actor = '' then 'missing_actor' end, case when timestamp = 'never' then 'missing_timestamp' end], lambda x: x is not null) as v from w),
    d as (select *, case when len(v) = 0 then 'accepted' when length(content) < 15 then 'rejected' else 'quarantined' end as disposition,
      case when project = '' then 'GENERAL' else upper(project) end || '/' || case when actor = '' then 'unknown' else split_part(actor, '/', 2) end as producer from v)"""


@query(f"with {WRITE_SQL} select event_id, array_to_string(v, '|') as violations, disposition, producer from d")
def contract_violations(spark, folder):
    return L.inspect_writes(writes(spark, folder)).select("event_id", bar("violations").alias("violations"), "disposition", "producer")


@query(
    f"""with {WRITE_SQL} select producer, count(*) as total, count(*) filter (disposition = 'accepted') as accepted, count(*) filter (disposition = 'quarantined') as quarantined,
      count(*) filter (disposition = 'rejected') as rejected, round(count(*) filter (disposition = 'accepted') / count(*), 4) as conformance from d group by 1"""
)
def producer_tally(spark, folder):
    return L.producer_tally(L.inspect_writes(writes(spark, folder)))


@query(f"with {WRITE_SQL} select producer, violation, count(*) as n from (select producer, unnest(v) as violation from d) group by 1, 2")
def violation_counts(spark, folder):
    return L.violation_counts(L.inspect_writes(writes(spark, folder)))


# ---- ledger -----------------------------------------------------------------------------------------------

_LEDGER = {
    "pos": "event_id", "kind": "case when event_id % 3 = 0 then 'query' else 'outcome' end",
    "event_id": "case when event_id % 41 = 0 then null else concat('q', user_id, '-', cast(floor(value) as bigint) % 3) end",
    "by": "concat('agent', user_id % 5)", "query": "concat('ask ', user_id % 4)", "found": "value > 5", "abstained": "case when event_id % 6 = 0 then event_type = 'click' end",
    "was_used": "case when event_id % 3 = 1 and event_type in ('click', 'view') then event_type = 'click' end",
    "was_correct": "case when event_id % 3 = 2 and event_type in ('error', 'view') then event_type = 'view' end",
}


def ledger_rows(spark, folder):
    return table(spark, folder, "events").selectExpr(*[f"{e} as {'`by`' if c == 'by' else c}" for c, e in _LEDGER.items()])


LEDGER_SQL = "r as (select " + ", ".join(f'{e} as "{c}"' for c, e in _LEDGER.items()) + """ from events),
    o as (select event_id, arg_max(was_used, pos) filter (was_used is not null) as was_used, arg_max(was_correct, pos) filter (was_correct is not null) as was_correct from r where kind = 'outcome' and event_id is not null group by 1),
    m as (select pos, event_id, "by", query, found, abstained, o.was_used, o.was_correct from (select pos, event_id, "by", query, found, abstained from r where kind = 'query' and event_id is not null) left join o using (event_id))"""


@query(f"with {LEDGER_SQL} select pos, event_id, found, was_used, was_correct from m")
def ledger_latest_outcome(spark, folder):
    return L.merge_ledger(ledger_rows(spark, folder)).select("pos", "event_id", "found", "was_used", "was_correct")


@query(f"""with {LEDGER_SQL} select query, "by", arg_max(coalesce(event_id, ''), pos) as event_id from r where kind = 'query' group by 1, 2""")
def ledger_latest_query(spark, folder):
    rows = ledger_rows(spark, folder).withColumn("event_id", F.coalesce("event_id", F.lit("")))
    return L.latest_for(rows, by_agent=True)


@query(
    f"""with {LEDGER_SQL}, a as (select count(*) as queries, count(distinct "by") as agents, count(*) filter (found) as answered, count(*) filter (found and was_used is not null) as ul, count(*) filter (found and was_used) as u,
      count(*) filter (found and was_correct is not null) as cl, count(*) filter (found and was_correct) as c, count(*) filter (found and abstained) as contradictions from m)
    select queries, agents, agents >= 2 as fleet_fed, answered, round(answered / queries, 4) as answered_rate, ul as usage_labelled, round(u / ul, 4) as usage_rate, cl as correctness_labelled,
      round(c / cl, 4) as fleet_accuracy, contradictions, queries > 0 as measured from a"""
)
def fleet_score(spark, folder):
    return L.fleet_score(L.merge_ledger(ledger_rows(spark, folder)))


_OT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: t not in (" + ",".join(f"'{w}'" for w in fixed.OUTCOME_STOPWORDS) + ")))"


@query(
    f"""with e as (select event_id, user_id % 10 as agent, epoch(ts) as ts, body, event_type, {_OT.format("body")} as w, {_OT.format("who || ' fixed parser in ' || city || ' shop sold pages'")} as m1, {_OT.format("'measured ' || who || ' fixed bm25 hits'")} as m2 from {MEMO_SQL}),
    r as (select * from e where event_id % 2 = 0), w as (select * from e where event_id % 2 = 1),
    h as (select distinct r.event_id from r join w on r.agent = w.agent and w.ts >= r.ts and w.ts - r.ts <= 1800
      where (len(r.m1) >= 4 and len(list_intersect(r.m1, w.w)) / len(r.m1) >= 0.6) or (len(r.m2) >= 4 and len(list_intersect(r.m2, w.w)) / len(r.m2) >= 0.6))
    select event_id, event_id in (select event_id from h) as was_used from r"""
)
def ttl_outcome_join(spark, folder):
    """Even events are recalls with two memories, odd events are texts written later."""
    m = memo(spark, folder).select(
        "event_id", F.expr("user_id % 10").alias("agent"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "body",
        F.array(F.expr("concat(who, ' fixed parser in ', city, ' shop sold pages')"), F.expr("concat('measured ', who, ' fixed bm25 hits')")).alias("memories"),
    )
    recalls = m.where("event_id % 2 = 0").select("event_id", "agent", "ts", "memories")
    later = m.where("event_id % 2 = 1").select(F.col("event_id").alias("write_id"), "agent", "ts", F.col("body").alias("text"))
    return L.match_outcomes(recalls, later)


# ---- calibration ----------------------------------------------------------------------------------------------


def examples(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.round(F.log(F.col("n_chars") + 1.0), 1).alias("score"))
    return table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("was_correct")).join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), "score", "was_correct"
    )


EX = "x as (select doc_id as id, round(ln(n_chars + 1.0), 1)::double as score, quality = 1 as ok from labels join documents using (doc_id))"
FIT = """t as (select s.score, count(*) as n_above, count(*) filter (not x.ok) as wrong from (select distinct score from x) s join x on x.score >= s.score group by 1),
    g as (select coalesce(min(score) filter (wrong / n_above <= {0}), max(score)) as threshold from t)"""


@query(f"with {EX}, {FIT.format(0.3)} select threshold, (select count(*) from x) as n_labelled, (select count(*) from x where score >= threshold) as n_accepted from g")
def calibration_threshold(spark, folder):
    return L.fit_gate(examples(spark, folder), 0.3, 30)


@query(
    f"""with {EX}, d as (select doc_id as id, round(ln(n_chars + 1.0), 2)::double as score from documents),
    e as (select d.id, d.score, count(x.id) as n, count(x.id) filter (x.ok) as c from d left join x on x.score >= d.score group by 1, 2)
    select id, round(case when n > 0 then c / n else 1.0 end, 9) as estimate, n as n_neighbours from e"""
)
def correctness_estimates(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.round(F.log(F.col("n_chars") + 1.0), 2).alias("score"))
    return L.estimate_correctness(examples(spark, folder), docs).select("id", F.round("estimate", 9).alias("estimate"), "n_neighbours")


SPLIT = """n as (select count(*) as n, least(greatest(1, round_even(count(*) * 0.25, 0)::bigint), count(*) - 1) as h from x),
    rk as (select *, row_number() over (order by score desc, id) as p from x), sp as (select rk.*, p = 1 or p > n - (h - 1) as holdout from rk, n)"""


@query(f"with {EX}, {SPLIT} select id, holdout from sp")
def holdout_split(spark, folder):
    return L.split_holdout(examples(spark, folder)).select("id", "holdout")


@query(
    f"""with {EX}, {SPLIT}, tr as (select * from sp where not holdout), ho as (select * from sp where holdout),
    t as (select s.score, count(*) as n_above, count(*) filter (not tr.ok) as wrong from (select distinct score from tr) s join tr on tr.score >= s.score group by 1),
    g as (select coalesce(min(score) filter (wrong / n_above <= 0.3), max(score)) as threshold from t),
    e as (select ho.id, ho.score, ho.ok, case when count(tr.id) > 0 then count(tr.id) filter (tr.ok) / count(tr.id) else 1.0 end as est from ho left join tr on tr.score >= ho.score group by 1, 2, 3)
    select count(*) as n_total, count(*) filter (score >= threshold) as n_accepted, round(avg(ok::int) filter (score >= threshold), 9) as accuracy, round(avg(est) filter (score >= threshold), 9) as mean_estimate,
      round(abs(avg(ok::int) filter (score >= threshold) - avg(est) filter (score >= threshold)), 9) as calibration_error from e, g"""
)
def holdout_report(spark, folder):
    parts = settle(L.split_holdout(examples(spark, folder)))
    train, held = parts.where("not holdout"), parts.where("holdout")
    decided = L.decide(L.estimate_correctness(train, held.select("id", "score")), L.fit_gate(train, 0.3, 30))
    out = L.holdout_report(decided.join(held.select("id", "was_correct"), "id"))
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("n_total", "n_accepted", r("accuracy"), r("mean_estimate"), r("calibration_error"))


CURVE = f"""{EX}, o as (select *, row_number() over (order by score desc, id) as k, sum(ok::int) over (order by score desc, id) as c, count(*) over () as n from x)"""


@query(f"with {CURVE} select id, k as answered, round(k / n, 9) as coverage, round(c / k, 9) as accuracy from o")
def risk_coverage_curve(spark, folder):
    o = examples(spark, folder).select("id", F.col("score").alias("confidence"), F.col("was_correct").alias("correct"))
    return M.risk_curve(o).select("id", "answered", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


AURC = """l as (select *, 1 - c / k as r, lag(1 - c / k) over (order by k) as pr from o),
    au as (select max(n) as total, round(arg_max(c / k, k), 9) as accuracy, round(sum((r + pr) / 2 / n), 9) as aurc, round(coalesce(max(k / n) filter (c / k >= 0.6), 0), 9) as coverage_at_target from l)"""


@query(f"with {CURVE}, {AURC} select * from au")
def risk_coverage_aurc(spark, folder):
    o = examples(spark, folder).select("id", F.col("score").alias("confidence"), F.col("was_correct").alias("correct"))
    out = M.risk_summary(M.risk_curve(o), 0.6)
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("total", r("accuracy"), r("aurc"), r("coverage_at_target"))


# ---- agreement, recall, failures -------------------------------------------------------------------------------


@query(
    """with p as (select quality = 1 as r, case when doc_id % 11 = 0 then null else toxic = 1 end as c from labels), a as (select count(*) as pairs, count(c) as n, count(*) filter (r and c) as yes,
      count(*) filter (not r and not c) as no, count(*) filter (r and c is not null) as ry, count(*) filter (c) as cy from p),
    b as (select *, (yes + no) / n as po, (ry * cy + (n - ry) * (n - cy)) / (n * n) as pc from a)
    select pairs, n as answered, pairs - n as unanswered, round(po, 4) as agreement, round(yes / ry, 4) as positive_agreement, round(no / (n - ry), 4) as negative_agreement,
      round((po - pc) / (1 - pc), 4) as cohen_kappa, n > 0 as measured from b"""
)
def judge_agreement(spark, folder):
    p = table(spark, folder, "labels").select(
        (F.col("quality") == 1).alias("reference"), F.when(F.col("doc_id") % 11 != 0, F.col("toxic") == 1).alias("candidate")
    )
    return M.judge_agreement(p)


def recall_rows(spark, folder, shift: int):
    """Per order: suppliers as ranked sessions, two of them as gold."""
    li = table(spark, folder, "lineitem")
    per = li.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("ranked")
    )
    gold = F.array(F.element_at("ranked", -1), F.get("ranked", F.lit(shift)))
    return per.select(
        "l_orderkey", F.expr("split_part('multi,single,update', ',', cast(1 + l_orderkey % 3 as int))").alias("qtype"),
        F.size(F.array_distinct("ranked")).alias("candidates"), *M.recall_curve(F.col("ranked"), gold, (1, 3, 5)),
    )


RECALL_SQL = """s as (select l_orderkey, list(l_suppkey order by l_linenumber, l_suppkey) as r from lineitem group by 1),
    k as (select l_orderkey, split_part('multi,single,update', ',', cast(1 + l_orderkey % 3 as int)) as qtype, len(list_distinct(r)) as candidates, r, list_distinct(list_filter([r[-1], r[{0} + 1]], lambda x: x is not null)) as g from s),
    c as (select *, len(list_intersect(g, r[1:1])) / len(g) as recall_1, len(list_intersect(g, r[1:3])) / len(g) as recall_3, len(list_intersect(g, r[1:5])) / len(g) as recall_5 from k),
    a as (select coalesce(qtype, 'overall') as qtype, count(*) as n, avg(recall_1) as mean_1, avg(recall_3) as mean_3, avg(recall_5) as mean_5, avg(case when recall_5 >= 1 then 1 else 0 end) as full_5, avg(candidates) as mean_candidates
      from c group by grouping sets ((qtype), ()))"""


@query(
    f"with {RECALL_SQL.format(0)} select qtype, n, round(mean_1, 9) as mean_1, round(mean_3, 9) as mean_3, round(mean_5, 9) as mean_5, round(full_5, 9) as full_5, round(mean_candidates, 9) as mean_candidates from a"
)
def recall_at_n(spark, folder):
    out = M.recall_aggregate(recall_rows(spark, folder, 0), (1, 3, 5))
    return out.select("qtype", "n", *[F.round(c, 9).alias(c) for c in ("mean_1", "mean_3", "mean_5", "full_5", "mean_candidates")])


@query(
    f"with a1 as (with {RECALL_SQL.format(0)} select * from a), a2 as (with {RECALL_SQL.format(2)} select * from a) select qtype, round(a1.mean_1 - a2.mean_1, 9) as delta_1, round(a1.mean_3 - a2.mean_3, 9) as delta_3, round(a1.mean_5 - a2.mean_5, 9) as delta_5 from a1 join a2 using (qtype)"
)
def recall_delta(spark, folder):
    a = M.recall_aggregate(recall_rows(spark, folder, 0), (1, 3, 5))
    b = M.recall_aggregate(recall_rows(spark, folder, 2), (1, 3, 5))
    out = M.recall_deltas(a, b, (1, 3, 5))
    return out.select("qtype", *[F.round(f"delta_{n}", 9).alias(f"delta_{n}") for n in (1, 3, 5)])


_DIAG = "case when doc_id % 7 = 0 then null else named_struct('answer_session_recall', case when doc_id % 5 = 0 then null else cast(doc_id % 4 as double) / 3 end, 'session_limited_answer_session_ids', case when doc_id % 6 = 1 then array('a') end, 'budget_dropped_answer_session_ids', case when doc_id % 6 < 3 then array('b') else array() end) end"


@query(
    """with k as (select doc_id, lang, case when quality = 1 then 'correct' when doc_id % 7 = 0 then 'missing_diagnostics' when doc_id % 5 = 0 then 'missing_answer_sessions' when doc_id % 4 = 3 then 'synthesis_failure'
      when doc_id % 6 = 1 then 'session_limit_miss' when doc_id % 6 < 3 then 'char_budget_miss' else 'retrieval_ranking_miss' end as failure_type from labels join documents using (doc_id))
    select coalesce(lang, 'overall') as question_type, failure_type, count(*) as n from k group by grouping sets ((lang, failure_type), (failure_type))"""
)
def failure_taxonomy(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    kind = M.failure_type(F.col("quality") == 1, F.expr(_DIAG))
    return M.failure_counts(rows.select(F.col("lang").alias("question_type"), kind.alias("failure_type")))


@query(
    """select event_type as config, coalesce(q, '_overall') as qtype, round(avg(value), 6) as mean, count(*) as n from (select event_type, value, 'type' || user_id % 4 as q from events) group by grouping sets ((event_type, q), (event_type))"""
)
def ablation_mean(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("config"), F.expr("concat('type', user_id % 4)").alias("qtype"), F.col("value").alias("recall"))
    return M.ablation(e).select("config", "qtype", F.round("mean", 6).alias("mean"), "n")


@query(
    """with p as (select p_partkey as id, p_brand as benchmark, p_retailprice as accuracy, case when p_size % 9 = 0 then null else p_size * 100 end as tokens, p_partkey % 97 as lat from part),
    q as (select *, round(accuracy * 1000.0 / tokens, 3) as eff from p),
    d as (select distinct a.id from q a join q b on a.benchmark = b.benchmark and b.eff is not null and a.eff is not null and b.accuracy >= a.accuracy and b.eff >= a.eff and b.lat <= a.lat and (b.accuracy > a.accuracy or b.eff > a.eff or b.lat < a.lat))
    select id, eff is not null and id not in (select id from d) as frontier from q"""
)
def pareto_frontier(spark, folder):
    p = table(spark, folder, "part").selectExpr(
        "p_partkey as id", "p_brand as benchmark", "p_retailprice as accuracy", "case when p_size % 9 = 0 then null else p_size * 100 end as tokens_total", "p_partkey % 97 as p95_latency_ms"
    )
    return M.pareto_frontier(p).select("id", "frontier")


_AXES = {
    "event_id": "event_id", "kind": "split_part('measured,curated,Falsified,producer_asserted,unknown', ',', cast(1 + event_id % 5 as int))",
    "status": "split_part('reference_validated,roadmap,refuted', ',', cast(1 + event_id % 3 as int))",
    "admission": "split_part('admitted,floored', ',', cast(1 + floor(event_id / 7) % 2 as int))",
    "fresh": "case floor(event_id / 11) % 3 when 0 then null when 1 then 'verified_at_source' else 'untraceable' end", "user_id": "user_id",
}


@query(
    f"""with a as (select {", ".join(f"{e} as {c}" for c, e in _AXES.items())} from events),
    m as (select user_id, event_id, case when kind = 'unknown' then 'boundary' when kind = 'Falsified' or status = 'refuted' then 'refuted' when kind = 'producer_asserted' then 'boundary'
      when status = 'reference_validated' and admission = 'admitted' and (fresh is null or fresh = 'verified_at_source') then 'validated' else 'boundary' end as mode from a)
    select user_id, event_id, mode from m union all select user_id, -1, case min(case mode when 'validated' then 2 when 'boundary' then 1 else 0 end) when 2 then 'validated' when 1 then 'boundary' else 'refuted' end from m group by 1"""
)
def presentation_modes(spark, folder):
    a = table(spark, folder, "events").selectExpr(*[f"{e} as {c}" for c, e in _AXES.items()])
    one = a.select("user_id", "event_id", M.presentation(F.col("kind"), F.col("status"), F.col("admission"), F.col("fresh")).alias("mode"))
    return one.unionByName(M.synthesis_mode(one, "user_id").select("user_id", F.lit(-1).cast("long").alias("event_id"), "mode"))


@query(
    """select o_orderkey, case when o_orderstatus = 'P' then 'forged' when o_custkey % 13 = 0 or o_orderpriority = '1-URGENT' or cast(o_orderdate as date) > date '1997-01-01'
      or (o_custkey % 4 <> 0 and cast(o_orderdate as date) + 400 < date '1997-01-01') then 'ungraded' else 'verified' end as verdict from orders"""
)
def as_of_validity(spark, folder):
    o = table(spark, folder, "orders")
    day = F.to_date("o_orderdate")
    f = o.select(
        "o_orderkey", F.concat(F.lit("d"), "o_custkey").alias("content_digest"), F.when(F.col("o_orderstatus") == "P", "forged").otherwise("verified").alias("base_verdict"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "retired").otherwise("Active").alias("lifecycle"), day.alias("valid_from"),
        F.when(F.col("o_custkey") % 4 != 0, F.date_add(day, 400)).alias("valid_to"),
    )
    void = table(spark, folder, "customer").where("c_custkey % 13 = 0").select(F.concat(F.lit("d"), "c_custkey").alias("content_digest"))
    return M.valid_as_of(f, F.lit("1997-01-01").cast("date"), void).select("o_orderkey", "verdict")


@query(
    """with r as (select l_shipmode_ as category, l_returnflag <> 'A' as ok, l_quantity * 1.5 as lat, l_linenumber as tokens from (select *, l_linestatus || l_linenumber % 3 as l_shipmode_ from lineitem) where l_suppkey % 9 <> 0),
    o as (select *, row_number() over (partition by category order by lat) as rn, count(*) over (partition by category) as c from r), a as (select *, row_number() over (order by lat) as rn, count(*) over () as c from r)
    select category, count(*) as total, count(*) filter (ok) as correct, round(avg(lat), 3) as latency_mean, round(median(lat), 3) as latency_p50, round(min(lat) filter (rn >= ceil(0.95 * c)), 3) as latency_p95, sum(tokens)::bigint as tokens,
      round(100.0 * count(*) filter (ok) / count(*), 1) as accuracy from o group by 1
    union all select 'overall', count(*), count(*) filter (ok), round(avg(lat), 3), round(median(lat), 3), round(min(lat) filter (rn >= ceil(0.95 * c)), 3), sum(tokens)::bigint, round(100.0 * count(*) filter (ok) / count(*), 1) from a"""
)
def benchmark_report(spark, folder):
    r = table(spark, folder, "lineitem").select(
        F.expr("concat(l_linestatus, l_linenumber % 3)").alias("category"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_returnflag") != "A").alias("judge_label"),
        (F.col("l_quantity") * 1.5).alias("latency_ms"), F.col("l_linenumber").alias("tokens"),
    )
    return M.benchmark_report(r)


_ENDPOINT = "case event_id % 6 when 0 then concat('http://localhost:', 8000 + user_id % 10, '/v1') when 1 then 'https://localhost.evil.com/x' when 2 then 'ollama:llama' when 3 then 'https://api.example.com' when 4 then '' else 'http://127.0.0.1:9' end"


@query("select count(*) filter (event_id % 6 in (1, 3, 4)) = 0 as pure_local, count(*) as total_calls, count(*) filter (event_id % 6 in (1, 3, 4)) as cloud_calls from events")
def egress_audit(spark, folder):
    return M.egress_audit(table(spark, folder, "events").select(F.expr(_ENDPOINT).alias("endpoint")))


@query(
    f"""with {CURVE}, {AURC} select accuracy, aurc, (select count(*) from events where event_id % 6 in (1, 3, 4)) as cloud_calls,
      (with {LEDGER_SQL} select round(count(*) filter (found and was_correct) / count(*) filter (found and was_correct is not null), 4) from m) as fleet_accuracy from au"""
)
def run_scorecard(spark, folder):
    fleet = L.fleet_score(L.merge_ledger(ledger_rows(spark, folder))).select("fleet_accuracy")
    egress = egress_audit(spark, folder).select("cloud_calls")
    lineage = table(spark, folder, "events").agg(F.count("*").alias("questions"))
    out = M.scorecard(risk_coverage_aurc(spark, folder), egress, lineage, fleet)
    return out.select("accuracy", "aurc", "cloud_calls", "fleet_accuracy")


@query(
    """with n as (select case when user_id % 50 = 0 then 'n0' else 'n' || user_id end as id, event_type = 'signup' as origin, case when value > 5 then 'n' || event_id % 20 end as parent, event_id as pos from events)
    select id, arg_max(origin, pos) as origin, arg_max(coalesce(parent, ''), pos) as parent from n group by 1"""
)
def provenance_nodes(spark, folder):
    link = F.struct(F.lit("derived_from").alias("type"), F.expr("case when value > 5 then concat('n', event_id % 20) end").alias("target"))
    n = table(spark, folder, "events").select(
        F.expr("case when user_id % 50 = 0 then 'n0' else concat('n', user_id) end").alias("id"), F.when(F.col("event_type") == "signup", "stated").otherwise("inferred").alias("source_quality"),
        F.array(F.struct(F.lit("related").alias("type"), F.lit("zz").alias("target")), link).alias("links"), F.col("event_id").alias("pos"),
    )
    return M.provenance_nodes(n).select("id", "origin", F.coalesce("parent", F.lit("")).alias("parent"))


@query(
    """select count(distinct s) as stages, count(*) as artifacts, round((select epoch_us(max(ts)) / 1e6 from events where event_type = 'click') - (select epoch_us(max(ts)) / 1e6 from events where event_type = 'view'), 3) as drift_seconds,
      ((select epoch_us(max(ts)) / 1e6 from events where event_type = 'click') - (select epoch_us(max(ts)) / 1e6 from events where event_type = 'view')) > 604800 as stale
      from (select case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as s from events)"""
)
def pipeline_freshness(spark, folder):
    e = table(spark, folder, "events").select(
        F.expr("case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end").alias("stage_pos"), F.col("ts").cast("timestamp").alias("modified")
    )
    return L.pipeline_freshness(e).withColumn("drift_seconds", F.round("drift_seconds", 3))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_remaining(spark, folder):
    done = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.remaining(table(spark, folder, "orders").select("o_orderkey"), done, "o_orderkey")


@query(
    r"""with w as (select conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{24F}0-9_]+'), lambda x: lower(x))) as t0, text from conversations),
    h as (select doc_id, lang, text, doc_id % (select max(conv_id) + 1 from conversations) as conv from documents join labels using (doc_id) where quality = 0),
    x as (select doc_id, lang, turn, list_distinct(list_filter(list_transform(regexp_extract_all(h.text, '[\p{L}\p{N}_]+'), lambda x: lower(x)), lambda x: regexp_full_match(x, '[a-z]{4,}'))) as a,
       list_distinct(list_filter(list_transform(regexp_extract_all(c.text, '[\p{L}\p{N}_]+'), lambda x: lower(x)), lambda x: regexp_full_match(x, '[a-z]{4,}'))) as b from h join conversations c on c.conv_id = h.conv)
    select doc_id as question_id, any_value(lang) as question_type, round(count(*) filter (len(list_intersect(a, b)) >= 2) / count(*), 9) as coverage from x where len(a) > 0 group by 1"""
)
def coverage_buckets(spark, folder):
    """Low-quality documents as hypotheses, turns of one conversation as answer sessions."""
    top = table(spark, folder, "conversations").agg(F.max("conv_id")).scalar()
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").where("quality = 0"), "doc_id")
    h = docs.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("question_type"), F.col("text").alias("hypothesis"), (F.col("doc_id") % (top + 1)).alias("conv_id"))
    turns_ = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("string").alias("session_id"), "text")
    ids = turns_.groupBy("conv_id").agg(F.collect_list("session_id").alias("answer_session_ids"))
    sessions = h.select("question_id", "conv_id").join(turns_, "conv_id").drop("conv_id")
    out = M.coverage_buckets(h.join(ids, "conv_id"), sessions)
    return out.select("question_id", "question_type", F.round("coverage", 9).alias("coverage"))


# ---- reader contexts --------------------------------------------------------------------------------------------


@query(
    """with r as (select o_custkey as query_id, o_orderkey % 40 as session_idx, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders),
    b as (select query_id, session_idx, min(rank) as best from r group by 1, 2), p as (select *, row_number() over (partition by query_id order by best, session_idx) as session_rank from b)
    select query_id, session_idx, session_rank, session_rank > 6 as over_limit from p"""
)
def session_limits(spark, folder):
    out = X.select_sessions(*order_sessions(spark, folder), 6, 3000)
    return out.select("query_id", "session_idx", "session_rank", (F.col("state") == "over_limit").alias("over_limit"))


def order_sessions(spark, folder):
    from ..plans.scale import ranked

    o = table(spark, folder, "orders")
    r = ranked(o.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 40).alias("session_idx"), "o_totalprice", "o_orderkey"), ["query_id"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    sizes = r.select("query_id", "session_idx").distinct().withColumn("n_chars", 300 + (F.col("session_idx") * 37) % 900)
    return r.select("query_id", "session_idx", "rank"), sizes


@query(
    """with recursive r as (select o_custkey as query_id, o_orderkey % 40 as session_idx, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders),
    b as (select query_id, session_idx, min(rank) as best from r group by 1, 2), p as (select *, row_number() over (partition by query_id order by best, session_idx) as k from b),
    w as (select query_id, 0::bigint as k, 0::bigint as used, []::bigint[] as kept from (select distinct query_id from p) union all
      select w.query_id, p.k, case when len(kept) = 0 or used + 302 + (session_idx * 37) % 900 <= 3000 then used + 302 + (session_idx * 37) % 900 else used end,
        case when len(kept) = 0 or used + 302 + (session_idx * 37) % 900 <= 3000 then list_append(kept, session_idx) else kept end from w join p on p.query_id = w.query_id and p.k = w.k + 1 where p.k <= 6)
    select query_id, unnest(arg_max(kept, k)) as session_idx from w group by 1"""
)
def session_selection(spark, folder):
    out = X.select_sessions(*order_sessions(spark, folder), 6, 3000)
    return out.where("state = 'selected'").select("query_id", "session_idx")


_KEYED = r"regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^[ .,:;-]+|[ .,:;-]+$', '', 'g')"


@query(
    rf"""with {FACTS_SQL}, k as (select scope, {_KEYED} as key, arg_min(text, fact_idx) as text, min(fact_idx) as first, arg_min(case when dated then valid_from else day end, fact_idx) as date, arg_min(valid_until <> '', fact_idx) as sup from facts group by 1, 2),
    o as (select *, row_number() over (partition by scope order by date desc, sup, first) as pos, length(text) + length(date) + 6 + case when sup then 13 else 0 end as size from k),
    c as (select *, 80 + sum(size) over (partition by scope order by pos) as used from o where pos <= 12)
    select scope, pos, date, sup as superseded from c where pos = 1 or used <= 900 qualify count(*) over (partition by scope order by pos) = pos"""
)
def lean_context(spark, folder):
    out = X.lean_context(windows(spark, folder), 12, 900)
    return out.select("scope", "pos", "date", "superseded")


@query(
    f"""with {FACTS_SQL}, l as (select scope, fact_idx, datediff('day', coalesce(try_cast(nullif(valid_from, '') as date), cast(day as date)), date '2024-01-20') as age from facts),
    t as (select *, case when age <= 1 then 'top_of_mind' when age <= 7 then 'work_context' else 'background' end as layer from l)
    select scope, fact_idx, layer, row_number() over (partition by scope, layer order by fact_idx) as pos from t qualify pos <= case layer when 'background' then 3 else 6 end"""
)
def hierarchical_context(spark, folder):
    out = X.layered_context(K.decompose(turns(spark, folder)), F.lit("2024-01-20").cast("date"))
    return out.select("scope", "fact_idx", "layer", "pos")


@query()
def entity_digests(spark, folder):
    facts = windows(spark, folder)
    asked = questions(spark, folder)
    found = K.query_facts(facts, asked.where("qtype <> 'temporal-reasoning'"), 20, **X.statements())
    return X.entity_digests(found, asked).select("query_id", "entity", "entity_rank", "pos", "date", "text")


@query(
    """with s as (select conv_id as context_id, turn as pos, text, length(text) as n, row_number() over (partition by conv_id order by turn) as k from conversations where trim(text) <> ''),
    c as (select *, sum(n + case when k > 1 then 2 else 0 end) over (partition by context_id order by k) as used from s),
    w as (select *, min(case when used > 600 then k end) over (partition by context_id) as cut from c)
    select context_id, pos, case when used <= 600 then n else 600 - (used - n - case when k > 1 then 2 else 0 end) - case when k > 1 then 2 else 0 end end as n_chars from w
    where (cut is null or k < cut) or (k = cut and 600 - (used - n - case when k > 1 then 2 else 0 end) - case when k > 1 then 2 else 0 end - 53 > 0)"""
)
def context_fit(spark, folder):
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("context_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return X.fit_context(c, 600).select("context_id", "pos", F.length("content").cast("bigint").alias("n_chars"))


@query()
def context_packing(spark, folder):
    from .search_queries import benchmark_queries, documents_as_paragraphs
    from ..operators.index import bm25_top

    docs = documents_as_paragraphs(spark, folder)
    top = bm25_top(docs, benchmark_queries(spark, folder), 3)
    full = top.join(docs.select("para_id", F.col("text").alias("content")), "para_id").select(
        "query_id", "rank", F.concat(F.lit("doc"), "para_id").alias("name"), "score", "content"
    )
    return X.pack_results(full, 60, 4000).select("query_id", "rank", "name", F.length("content").alias("n_chars"))


# ---- research measures --------------------------------------------------------------------------------------------


@query()
def hash_patterns(spark, folder):
    d = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    return M.hash_patterns(d, 1000).select("id", "idx", F.round("value", 6).alias("value"))


@query(
    """with s as (select user_id as neuron, event_id % 1003 as step from events), p as (select neuron, case when step < 3 * 126 then step // 126 else 3 + (step - 3 * 126) // 125 end as bin from s)
    select neuron, bin::int as bin, count(*) as n from p group by 1, 2"""
)
def temporal_signature(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("neuron"), (F.col("event_id") % 1003).alias("step"))
    return M.temporal_signature(e, 1003, 8)


@query("select round(avg(abs(o_totalprice - 100000)) / avg(abs(o_custkey)), 6) as ratio from orders")
def recurrence_ratio(spark, folder):
    o = table(spark, folder, "orders").select((F.col("o_totalprice") - 100000).alias("recurrent"), F.col("o_custkey").alias("input"))
    return M.recurrence_ratio(o).select(F.round("ratio", 6).alias("ratio"))


@query("select round(sqrt(avg(cos(value)) ** 2 + avg(sin(value)) ** 2), 9) as coherence from events")
def order_parameter(spark, folder):
    return M.order_parameter(table(spark, folder, "events").select(F.col("value").alias("phase"))).select(F.round("coherence", 9).alias("coherence"))


@query()
def paired_bootstrap(spark, folder):
    p = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("value").alias("trained"), (F.col("user_id") % 20).cast("double").alias("control"))
    out = M.paired_interval(p, samples=200)
    return out.select("pairs", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")])


@query(
    """with w as (select p_partkey, list_distinct(string_split(lower(p_name), ' ')) as f, lower(p_brand) as b, lower(p_name || ' ' || p_type) as c, list_distinct(string_split(lower(p_type), ' ')) as m from part)
    select p_partkey, round((least(3, len(list_filter(f, lambda x: length(x) > 3 and contains(c, x)))) + case when contains(c, b) and length(b) > 3 then 1 else 0 end
      + least(2, len(list_filter(m, lambda x: length(x) > 3 and contains(c, x))))) / 6, 9) as continuity from w where not contains(b, ' ')"""
)
def continuity_scores(spark, folder):
    p = table(spark, folder, "part").where(~F.col("p_brand").contains(" "))
    score = M.continuity_score(F.col("p_name"), F.array("p_brand"), F.col("p_type"), F.array().cast("array<string>"), F.concat_ws(" ", "p_name", "p_type"))
    return p.select("p_partkey", F.round(score, 9).alias("continuity"))


@query(
    """with e as (select l_suppkey as src, l_partkey as dst, sum(l_quantity) as w from lineitem group by 1, 2), n as (select src, dst, w / (select max(w) from e) as w from e),
    h as (select src from (select src, round(sum(w), 9) as s from n group by 1) order by s desc, src limit 20), k as (select *, row_number() over (partition by src order by w desc, dst) as rk from n where src in (select src from h) and src <> dst and w >= 0.001)
    select distinct least(src, dst) as src, greatest(src, dst) as dst, round(w, 4) as weight from k where rk <= 5"""
)
def hub_graph(spark, folder):
    e = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return M.hub_graph(e)
