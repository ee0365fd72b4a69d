"""Queries for notes, graphs, consolidation and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import consolidate as C
from ..operators import notes as N
from ..operators import recall as R
from ..plans import graph as G
from ..plans.scale import top_per_key
from ..plans.simjoin import leaders
from ..session import settle
from .base import MEMO_SQL, derive, derive_sql, memo, query, table
from .search_queries import TOKENS
from .text_queries import (
    NOTE_ENTITIES_SQL,
    STRIP,
    TRACE_ENTITIES_SQL,
    chain_sql,
    relation_sql,
    words_sql,
)

# ---- near duplicates and links ------------------------------------------------------------------

_GREEDY = """sim as (select a.id as a, b.id as b, len(list_intersect(a.t, b.t)) as c, len(a.t) as n, len(b.t) as m from s a join s b on a.id < b.id
      and least(len(a.t), len(b.t)) > {1} * greatest(len(a.t), len(b.t))),
    e as (select a, b, c / (n + m - c) as j from sim where c / (n + m - c) > {1}),
    ord as (select id, row_number() over (order by id) as i from s),
    nb as (select ord.i, ord.id, coalesce((select list(a) from e where e.b = ord.id), []) as before from ord),
    walk as (select 0::bigint as i, []::bigint[] as lead union all
      select walk.i + 1, case when len(list_intersect(nb.before, walk.lead)) > 0 then walk.lead else list_append(walk.lead, nb.id) end
      from walk join nb on nb.i = walk.i + 1),
    fin as (select lead from walk order by i desc limit 1),
    l as (select unnest(lead) as id from fin),
    best as (select e.b as id, arg_max(e.a, (e.j, -e.a)) as leader, max(e.j) as similarity from e join l on l.id = e.a where e.b not in (select id from l) group by 1)"""


@query(
    f"""with recursive s as (select doc_id as id, list_distinct({TOKENS.format('text')}) as t from documents), {_GREEDY.format('', '0.9')}
    select s.id, coalesce(best.leader, s.id) as leader, round(coalesce(best.similarity, 1.0), 9) as similarity from s left join best using (id)"""
)
def near_duplicates(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", T.note_tokens(F.col("text")).alias("t"))
    return leaders(docs, "doc_id", "t", 0.9).select("id", "leader", F.round("similarity", 9).alias("similarity"))


@query(
    f"""with recursive s as (select doc_id as id, list_distinct({TOKENS.format('text')}) as t from documents), {_GREEDY.format('', '0.9')},
    g as (select s.id, coalesce(best.leader, s.id) as leader from s left join best using (id))
    select leader, arg_max(id, (length(text), -id)) as kept, count(*) as n_merged from g join documents on doc_id = g.id group by 1"""
)
def merged_notes(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    assigned = leaders(docs.select("doc_id", T.note_tokens(F.col("text")).alias("t")), "doc_id", "t", 0.9)
    tagged = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("n")).join(assigned, "id")
    best = top_per_key(tagged, ["leader"], [F.desc("n"), F.asc("id")], 1).select("leader", F.col("id").alias("kept"))
    return best.join(tagged.groupBy("leader").agg(F.count("*").alias("n_merged")), "leader")


@query(
    f"""with a as (select item_id as seq, list_distinct({TOKENS.format('text')}) as t from benchmark), b as (select doc_id as target, list_distinct({TOKENS.format('text')}) as t from documents),
    j as (select seq, target, len(list_intersect(a.t, b.t)) as c, len(a.t) as n, len(b.t) as m from a, b where seq <> target),
    s as (select seq, target, c / (n + m - c) as sim from j where c > 0 and c / (n + m - c) > 0.1)
    select seq, target, round(sim, 9) as similarity, row_number() over (partition by seq order by round(sim, 9) desc, target) as rank from s qualify rank <= 3"""
)
def similar_links(spark, folder):
    new = table(spark, folder, "benchmark").select(F.col("item_id").alias("seq"), T.note_tokens(F.col("text")).alias("tokens"))
    old = table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), T.note_tokens(F.col("text")).alias("tokens"))
    return N.similar_links(new, old).select("seq", "target", F.round("similarity", 9).alias("similarity"), "rank")


#: incoming notes, one per nation
_INCOMING = {
    "seq": "cast(1000000000 + n_nationkey as bigint)",
    "content": "concat('Retrieval note ', n_nationkey, '. The gpu daemon ', case when n_nationkey % 2 = 0 then 'works' else 'failed' end, ' with v2.', n_nationkey % 7, ' at ', n_nationkey * 4, '% load. ', case when n_nationkey % 3 = 0 then 'Accuracy dropped.' else 'Parsing was improved.' end)",
}


def incoming(spark, folder):
    c = F.col("content")
    return derive(table(spark, folder, "nation"), _INCOMING).withColumn("entities", T.note_entities(c))


def stored(spark, folder):
    c = F.col("content")
    return memo(spark, folder).select(F.col("event_id").alias("seq"), F.col("text").alias("content")).withColumn("entities", T.note_entities(c))


_NEW = f"n as (select seq, content, {NOTE_ENTITIES_SQL.format('content')} as es from ({derive_sql('nation', _INCOMING)}))"
_OLD = f"o as (select event_id as seq, text as content, {NOTE_ENTITIES_SQL.format('text')} as es from {MEMO_SQL})"


@query(
    f"""with {_NEW}, {_OLD} select n.seq, o.seq as target, array_to_string(list_sort(list_intersect(n.es, o.es))[1:5], '|') as shared
    from n join o on len(list_intersect(n.es, o.es)) >= 2"""
)
def shared_entity_links(spark, folder):
    found = N.shared_entity_links(incoming(spark, folder), stored(spark, folder))
    return found.select("seq", "target", F.array_join("shared", "|").alias("shared"))


@query(
    f"""with {_OLD}, p as (select seq, unnest(es) as e from o) select a.e as e1, b.e as e2, count(*) as n_notes from p a join p b on a.seq = b.seq and a.e < b.e group by 1, 2"""
)
def entity_pair_hubs(spark, folder):
    return N.entity_pairs(stored(spark, folder)).groupBy("e1", "e2").agg(F.count("*").alias("n_notes"))


def _has(words: list[str]) -> str:
    return "len(list_intersect(" + TOKENS.format("content") + ", [" + ",".join(f"'{w}'" for w in words) + "])) > 0"


_ACT = "select seq, es, {0} as pos, {1} as neg, list_sort(list_distinct(regexp_extract_all(content, '\\d+(?:\\.\\d+)?%'))) as pct from {2}"


@query(
    f"""with {_NEW}, {_OLD}, a as ({_ACT.format(_has(fixed.POSITIVE_ACTIONS), _has(fixed.NEGATIVE_ACTIONS), 'n')}), b as ({_ACT.format(_has(fixed.POSITIVE_ACTIONS), _has(fixed.NEGATIVE_ACTIONS), 'o')})
    select a.seq, min(b.seq) as target from a join b on len(list_intersect(a.es, b.es)) >= 1
      and ((a.pos and b.neg) or (a.neg and b.pos) or (len(a.pct) > 0 and len(b.pct) > 0 and a.pct <> b.pct and len(list_intersect(a.es, b.es)) >= 2)) group by 1"""
)
def contradicted_notes(spark, folder):
    return N.contradictions(incoming(spark, folder), stored(spark, folder))


@query(
    f"""with t as (select event_id as trigger_id, case when event_id % 3 = 0 then concat(who, ' parser ', city) else concat('refund ', city, ' plan now') end as condition, event_id % 4 <> 1 as active from {MEMO_SQL}),
    c as (select trigger_id, list_distinct({TOKENS.format('condition')}) as c from t where active),
    qs as (select n_nationkey as query_id, list_distinct({TOKENS.format("concat('The parser in ', split_part('Oslo,Lima,Kyoto,Quito,Riga,Turin', ',', cast(1 + n_nationkey % 6 as int)), ' broke the refund plan for Alice')")}) as q from nation)
    select query_id, trigger_id from qs, c where len(list_intersect(q, c)) / len(c) > 0.5"""
)
def trigger_matches(spark, folder):
    m = memo(spark, folder)
    triggers = m.select(
        F.col("event_id").alias("trigger_id"),
        F.expr("case when event_id % 3 = 0 then concat(who, ' parser ', city) else concat('refund ', city, ' plan now') end").alias("condition"),
        F.expr("event_id % 4 <> 1").alias("active"),
    )
    asked = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("query_id"),
        F.expr("concat('The parser in ', split_part('Oslo,Lima,Kyoto,Quito,Riga,Turin', ',', cast(1 + n_nationkey % 6 as int)), ' broke the refund plan for Alice')").alias("query"),
    )
    return N.fired_triggers(triggers, asked)


_EVIDENCE = "split_part('confirmed,contradicted,accessed,stale,confirmed', ',', cast(1 + event_id % 5 as int))"


@query(
    f"""with e as (select user_id as id, event_id, {_EVIDENCE} as ev from events),
    l as (select id, list(case ev when 'confirmed' then 1.0 when 'contradicted' then 2.0 when 'accessed' then 3.0 else 4.0 end order by event_id) as l,
      count(*) filter (ev = 'confirmed') as confirmed, count(*) filter (ev = 'contradicted') as contradicted from e group by 1)
    select id, round(list_reduce(list_prepend(0.5::double, list_transform(l, lambda x: x::double)), lambda c, x: case when x = 1 then least(1.0, c + 0.1 * (1 - c)) when x = 2 then greatest(0.0, c - 0.15)
      when x = 3 then least(1.0, c + 0.02) else greatest(0.1, c - 0.01) end), 9) as confidence, confirmed, contradicted from l"""
)
def confidence_replay(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.expr(_EVIDENCE).alias("event"))
    out = N.confidence_after(events, chunk=64)
    return out.select("id", F.round("confidence", 9).alias("confidence"), "confirmed", "contradicted")


# ---- graphs -----------------------------------------------------------------------------------------

_LINK = "case event_id % 3 when 0 then 'depends_on' when 1 then 'contains' else 'related' end"


def links(spark, folder):
    e = table(spark, folder, "events").where("event_id > 0")
    return N.typed_links(e.select(F.col("event_id").alias("src"), F.expr("cast(floor(event_id / 3) as bigint)").alias("dst"), F.expr(_LINK).alias("type")))


LINKS_SQL = f"""l0 as (select event_id as src, event_id // 3 as dst, {_LINK} as type from events where event_id > 0),
    l as (select src, dst, type from l0 union all select dst, src, case type when 'depends_on' then 'derived_from' when 'contains' then 'related' else type end from l0)"""


@query(f"with {LINKS_SQL} select type, count(*) as n, count(distinct src) as n_src from l group by 1")
def typed_link_counts(spark, folder):
    return links(spark, folder).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"))


@query(
    f"""with recursive {LINKS_SQL}, w as (select n_nationkey::bigint as root, n_nationkey::bigint as node, 0 as hops from nation union
      select root, l.dst, hops + 1 from w join l on l.src = node where hops < 3 and type <> 'derived_from')
    select root, node, min(hops) as hops from w group by 1, 2 having min(hops) > 0"""
)
def bfs_related(spark, folder):
    seeds = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return N.related(seeds, links(spark, folder), 3, ["depends_on", "contains", "related"])


@query()
def graph_note_search(spark, folder):
    c = F.col("content")
    notes = stored(spark, folder).withColumn("keywords", T.extract_keywords(c)).withColumn(
        "prospective_queries", T.note_queries(c, F.lit(""), F.col("entities"), F.col("keywords"))
    )
    asked = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("query_id"),
        F.expr("concat('parser v1.', n_nationkey % 5, ' broke in ', split_part('Oslo,Lima,Kyoto,Quito,Riga,Turin', ',', cast(1 + n_nationkey % 6 as int)))").alias("query"),
    )
    return N.graph_search(notes, links(spark, folder), asked, 5, 2).select("query_id", "seq", F.round("score", 9).alias("score"), "rank")


_PARENT = """case when event_id % 17 = 3 then event_id + 2 when event_id % 17 = 5 then event_id - 2 when event_id % 23 = 1 then -1
  when event_id < 3 then null else cast(floor(event_id / 2) as bigint) end"""


@query(
    f"""with recursive n as (select event_id as id, event_id % 29 = 7 or event_id = 0 as origin, {_PARENT} as parent from events),
    w as (select id as root, id, origin, parent, 0 as d from n union all select w.root, n.id, n.origin, n.parent, d + 1 from w join n on n.id = w.parent where not w.origin and d < 60),
    c as (select root as id, bool_or(origin) as complete from w group by 1),
    a as (select conv_id, conv_id * 7 + turn * 3 as cited from conversations)
    select conv_id as answer_id, bool_and(coalesce(complete, false)) as visible from a left join c on c.id = a.cited group by 1"""
)
def lineage_completeness(spark, folder):
    nodes = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.expr("event_id % 29 = 7 or event_id = 0").alias("origin"), F.expr(_PARENT).alias("parent")
    )
    done = G.reaches_origin(nodes)
    cites = table(spark, folder, "conversations").select(F.col("conv_id").alias("answer_id"), F.expr("conv_id * 7 + turn * 3").alias("id"))
    full = cites.join(done, "id", "left")
    return full.groupBy("answer_id").agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("visible"))


@query(
    """with recursive e as (select distinct s_nationkey as a, 1000 + s_suppkey % 40 as b from supplier), b as (select a as src, b as dst from e union select b, a from e),
    w as (select src as node, src as low from b union select b.dst, low from w join b on b.src = w.node where low < b.dst or true),
    c as (select node, min(low) as comp from w group by 1)
    select (select count(*) from c) as vertices, (select count(*) from e) as edges, count(distinct comp) as components,
      greatest((select count(*) from e) + count(distinct comp) - (select count(*) from c), 0) as betti_1,
      round(ln(1 + greatest((select count(*) from e) + count(distinct comp) - (select count(*) from c), 0)) / ln(1 + (select count(*) from c)), 9) as persistence from c"""
)
def graph_loops(spark, folder):
    e = table(spark, folder, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("src"), F.expr("1000 + s_suppkey % 40").alias("dst")
    ).distinct()
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    out = G.loop_count(nodes, e)
    return out.withColumn("persistence", F.round("persistence", 9))


# ---- reflection ------------------------------------------------------------------------------------------


@query()
def note_clusters(spark, folder):
    c = F.col("content")
    notes = stored(spark, folder).withColumn("keywords", T.extract_keywords(c))
    return N.note_clusters(notes)


@query(
    f"""with {_OLD}, x as (select {words_sql('lower(content)', ['decided', 'chose', 'will'])} as d, {words_sql('lower(content)', ['found', 'measured', 'scored'])} as f, unnest(es) as entity from o),
    g as (select entity, bool_or(d) as d, bool_or(f) as f from x group by 1) select entity from g where d and not f order by entity limit 5"""
)
def knowledge_gaps(spark, folder):
    return N.knowledge_gaps(stored(spark, folder))


@query(
    f"""select event_id, name from {MEMO_SQL} where event_id % 10 = 3 and event_id % 4 <> 0"""
)
def open_contradictions(spark, folder):
    m = memo(spark, folder).select(
        "event_id", "name", F.expr("case when event_id % 10 = 3 then cast(event_id - 1 as string) else '' end").alias("supersedes"),
        F.expr("case when event_id % 4 = 0 then cast(event_id + 1 as string) end").alias("superseded_by"),
    )
    return N.open_contradictions(m).select("event_id", "name")


@query(f"select event_id from {MEMO_SQL} where day >= '2024-01-25' or day >= '2024-01-25'")
def recent_notes(spark, folder):
    m = memo(spark, folder).select("event_id", F.col("day").alias("created"), F.col("day").alias("updated"))
    return N.recent(m, "2024-01-25").select("event_id")


def skill_traces(spark, folder):
    return memo(spark, folder).select(F.col("event_id").alias("trace_id"), "name", "text")


@query(
    rf"""with recursive l as (select event_id, name, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from {MEMO_SQL}),
    c as (select event_id * 65536 + i as id, name, {STRIP.format("regexp_replace(" + STRIP.format('raw') + ", '^[- ]+', '')")} as line from l),
    k as (select id, name, substr(line, 1, 200) as text, list_distinct(regexp_extract_all(lower(line), '[a-z0-9_]+')) as t from c where line <> '' and line not like '#%' and
      ({' or '.join(f"(regexp_matches(lower(line), '{a}') and regexp_matches(lower(line), '{b}'))" for a, b in fixed.SKILL_MARKERS)}))
    select id as seq, name as source, text from k""",
)
def skill_entries(spark, folder):
    return N.skill_entries(skill_traces(spark, folder)).select("seq", "source", "text")


@query()
def skill_clusters(spark, folder):
    found = N.mine_skills(N.skill_entries(skill_traces(spark, folder)))
    return found.select("leader", "name", "description", "frequency", "n_sources", "last_seen")


# ---- consolidation ---------------------------------------------------------------------------------------------


def user_traces(spark, folder):
    """Memos as traces; every user is a project."""
    return memo(spark, folder).select("name", F.col("user_id").cast("string").alias("project"), F.col("day").alias("date"), "event_id", "text")


@query(
    f"""with t as (select name, user_id::string as project, day as date from {MEMO_SQL}),
    g as (select *, case when coalesce(abs(datediff('day', cast(lag(date) over w as date), cast(date as date))), 0) > 2 then 1 else 0 end as s from t window w as (partition by project order by date, name))
    select name, project, sum(s) over (partition by project order by date, name) as cluster from g"""
)
def gap_clusters(spark, folder):
    return C.cluster_traces(user_traces(spark, folder)).select("name", "project", "cluster")


_TYPE = chain_sql([(n, words_sql("lower(name)", w)) for n, w in fixed.TRACE_TYPES], "general")


@query(
    rf"""with t as (select name, project, day as date, {_TYPE} as type, {TRACE_ENTITIES_SQL.format('text')} as es from {MEMO_SQL}),
    g as (select *, case when coalesce(abs(datediff('day', cast(lag(date) over w as date), cast(date as date))), 0) > 2 then 1 else 0 end as s from t window w as (partition by project order by date, name)),
    c as (select *, sum(s) over (partition by project order by date, name) as cluster from g),
    m as (select project, cluster, type, count(*) as n, min(date || name) as a0 from c group by 1, 2, 3),
    y as (select project, cluster, type as main_type, row_number() over (partition by project, cluster order by n desc, a0) as rn from m),
    e as (select project, cluster, count(distinct e) as n_entities from (select project, cluster, unnest(es) as e from c) group by 1, 2)
    select project, cluster, min(date) as date, any_value(main_type) as main_type, count(*) as n_traces, any_value(n_entities) as n_entities from c
      join (select * from y where rn = 1) using (project, cluster) join e using (project, cluster) group by 1, 2"""
)
def consolidation(spark, folder):
    analyzed = C.analyze_traces(memo(spark, folder).select("name", "text", "project")).drop("project")
    named = analyzed.join(memo(spark, folder).select("name", "project"), "name")
    out = C.cluster_summary(C.cluster_traces(named))
    return out.select("project", "cluster", "date", "main_type", "n_traces", "n_entities")


def memo_pairs(spark, folder):
    c = F.col("text")
    return C.trace_relations(memo(spark, folder).select("name", F.col("day").alias("date"), "text", T.trace_entities(c).alias("entities")))


PAIRS_SQL = rf"""e0 as (select name, day, text, {TRACE_ENTITIES_SQL.format('text')} as es from {MEMO_SQL}),
    p0 as (select name, day, text, unnest(es) as e, generate_subscripts(es, 1) as i from e0),
    l1 as (select *, strpos(lower(text), lower(e)) - 1 as pos from p0 where strpos(lower(text), lower(e)) > 0),
    j0 as (select a.name, a.day, least(a.e, b.e) as source, greatest(a.e, b.e) as target,
      substr(a.text, least(a.pos, b.pos) + 1, greatest(a.pos + length(a.e), b.pos + length(b.e)) - least(a.pos, b.pos)) as t from l1 a join l1 b on a.name = b.name and a.i < b.i),
    pairs as (select name, day, source, target, {relation_sql('t', "'co_occurs'")} as type from j0),
    rel as (select source, target, coalesce(min_by(type, day || name) filter (type <> 'co_occurs'), 'co_occurs') as type, count(*) as weight from pairs group by 1, 2)"""


@query(f"with {PAIRS_SQL} select source, target, type, weight from rel")
def entity_graph(spark, folder):
    return C.relation_table(memo_pairs(spark, folder))


@query(
    f"""with e as (select day, unnest({TRACE_ENTITIES_SQL.format('text')}) as id from {MEMO_SQL})
    select id, case when id in ('bm25', 'gpu') then 'project' else 'concept' end as type, id as label, min(day) as first_seen, count(*) as trace_count from e group by 1"""
)
def entity_nodes(spark, folder):
    traces = memo(spark, folder).select("name", F.col("day").alias("date"), T.trace_entities(F.col("text")).alias("entities"))
    return C.entity_table(traces, ["bm25", "gpu"])


_UPSERT = "with a as (select o_orderstatus as source, o_orderpriority as target, case when o_orderstatus = 'F' then 'co_occurs' else 'fixed_by' end as type, count(*) as weight from orders group by 1, 2, 3)"


@query(
    _UPSERT + """, b as (select source, target, 'improved' as type, weight * 2 as weight from a),
    u as (select *, 0 as o from a union all select *, 1 from b)
    select source, target, coalesce(min_by(type, o) filter (type <> 'co_occurs'), 'co_occurs') as type, sum(weight)::bigint as weight from u group by 1, 2"""
)
def relation_upsert(spark, folder):
    o = table(spark, folder, "orders")
    stored_ = o.groupBy(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("target")).agg(F.count("*").alias("weight")).withColumn(
        "type", F.when(F.col("source") == "F", "co_occurs").otherwise("fixed_by")
    )
    fresh = stored_.select("source", "target", F.lit("improved").alias("type"), (F.col("weight") * 2).alias("weight"))
    return C.upsert_relations(stored_, fresh)


def order_memories(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.expr("case o_orderstatus when 'F' then 'active' when 'O' then 'stale' else 'validated' end").alias("validity_state"),
        F.to_date("o_orderdate").alias("last_accessed"),
    )


@query(
    """with m as (select case o_orderstatus when 'F' then 'active' when 'O' then 'stale' else 'validated' end as s, datediff('day', cast(o_orderdate as date), date '1996-06-30') as age from orders),
    n as (select s, case when s in ('active', 'validated') and age > 90 then 'stale' when s = 'stale' and age > 365 then 'archived' else s end as t from m)
    select s || '_to_' || t as transition, count(*) as n from n where s <> t group by 1"""
)
def memory_ageing(spark, folder):
    return C.age_memories(order_memories(spark, folder), F.lit("1996-06-30").cast("date"))[1]


@query(
    """with m as (select case when source in ('src1', 'src2') then 'decision' when source = 'src3' then 'personal' else source end as category, text,
      case lang when 'en' then 'active' when 'de' then 'stale' when 'fr' then 'validated' else 'archived' end as s from documents),
    g as (select category, sum(length(text)) as chars, case category when 'decision' then 50000 when 'personal' then 20000 else 50000 end as char_limit, count(*) as file_count,
      count(*) filter (s = 'active') as active, count(*) filter (s = 'validated') as validated, count(*) filter (s = 'stale') as stale, count(*) filter (s = 'archived') as archived from m group by 1)
    select category, chars::bigint as chars, char_limit, round(100 * chars / char_limit, 1) as usage_pct, round(100 * chars / char_limit, 1) >= 80 as needs_consolidation, file_count, active, validated, stale, archived from g"""
)
def capacity_report(spark, folder):
    d = table(spark, folder, "documents").select(
        F.expr("case when source in ('src1', 'src2') then 'decision' when source = 'src3' then 'personal' else source end").alias("category"),
        F.col("text").alias("content"),
        F.expr("case lang when 'en' then 'active' when 'de' then 'stale' when 'fr' then 'validated' else 'archived' end").alias("validity_state"),
    )
    return C.capacity_report(d)


def level_nodes(spark, folder):
    m = memo(spark, folder).select(
        "name", F.col("day").alias("date"), "project", T.trace_entities(F.col("text")).alias("entities"),
        T.extract_key_lines(F.col("text")).alias("key_lines"), "text",
    )
    return C.summary_levels(m)


def _levels_sql(most: int = 14) -> str:
    """A level above each one that has more than one node; 4 ** 14 leaves are far more than the test tables have."""
    steps = [f"l0 as (select 0 as level, row_number() over (order by day, name) as pos, day as first, day as last from {MEMO_SQL})"]
    for k in range(most):
        steps.append(f"l{k + 1} as (select {k + 1} as level, (pos - 1) // 4 + 1 as pos, min(first) as first, max(last) as last from l{k} where (select count(*) from l{k}) > 1 group by 2)")
    return "with " + ",\n".join(steps) + " " + " union all ".join(f"select level, pos, first, last from l{k}" for k in range(most + 1))


@query(_levels_sql())
def summary_levels(spark, folder):
    return level_nodes(spark, folder).select("level", "pos", "first", "last")


@query()
def summary_search(spark, folder):
    asked = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("query_id"),
        F.expr("concat('parser failed in ', split_part('Oslo,Lima,Kyoto,Quito,Riga,Turin', ',', cast(1 + n_nationkey % 6 as int)))").alias("query"),
    )
    return C.search_levels(level_nodes(spark, folder), asked, 5)


@query(
    """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    p as (select vec_id, unnest(e) as x, generate_subscripts(e, 1) as d from v),
    m as (select vec_id, x, avg(x) over (partition by d order by vec_id rows between unbounded preceding and 1 preceding) as m from p)
    select vec_id, round(case when max(m) is null then 1 else 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) end, 8) as novelty from m group by 1"""
)
def running_novelty(spark, folder):
    return C.novelty(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id").select("vec_id", F.round("novelty", 8).alias("novelty"))


# ---- recall -------------------------------------------------------------------------------------------------------


@query(
    f"""with {PAIRS_SQL}, b as (select source as entity, target as other, type, weight from rel union all select target, source, type, weight from rel)
    select entity, other, type, weight, row_number() over (partition by entity order by weight desc, other, type) as rank from b qualify rank <= 10"""
)
def related_topk(spark, folder):
    rel = settle(C.relation_table(memo_pairs(spark, folder)))
    asked = rel.select(F.col("source").alias("entity")).unionByName(rel.select(F.col("target").alias("entity"))).distinct().withColumn("query_id", F.col("entity"))
    return R.related_entities(asked, rel, 10).select("entity", "other", "type", "weight", "rank")


@query(
    f"""with {PAIRS_SQL}, b as (select source as entity, target as other, weight from rel union all select target, source, weight from rel),
    a as (select n_nationkey as query_id, unnest(['bm25', 'v2.' || n_nationkey % 7, 'daemon', 'v1.' || n_nationkey % 5]) as entity, unnest([0, 1, 2, 3]) as place from nation),
    n as (select query_id, entity, place, other, weight, row_number() over (partition by query_id, entity order by weight desc, other) as rank from a join b using (entity)),
    h as (select * from n where rank <= 20 and other in ('gpu', 'bm25', 'pytorch') and not (other = 'bm25')),
    f as (select query_id, other as project, weight from h qualify row_number() over (partition by query_id, other order by place, rank) = 1),
    s as (select f.query_id, project, count(*) as n_shared from f join b on b.entity = project join a on a.query_id = f.query_id and a.entity = b.other group by 1, 2)
    select query_id, project, weight, coalesce(n_shared, 0) as n_shared, row_number() over (partition by query_id order by weight desc, project) as rank from f left join s using (query_id, project) qualify rank <= 5"""
)
def cross_project(spark, folder):
    rel = settle(C.relation_table(memo_pairs(spark, folder)))
    ents = rel.select(F.col("source").alias("id")).unionByName(rel.select(F.col("target").alias("id"))).distinct().withColumn(
        "type", F.when(F.col("id").isin("gpu", "bm25", "pytorch"), "project").otherwise("concept")
    )
    asked = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("query_id"),
        F.expr("posexplode(array('bm25', concat('v2.', n_nationkey % 7), 'daemon', concat('v1.', n_nationkey % 5))) as (place, entity)"),
    )
    return R.cross_project(asked, ents, rel).select("query_id", "project", "weight", "n_shared", "rank")


@query(
    """with n as (select o_orderkey::string as name, row_number() over (order by o_orderkey::string) as p from orders)
    select a.name, b.name as other, (b.p - a.p)::int as distance from n a join n b on b.p between a.p - 3 and a.p + 3 and b.p <> a.p"""
)
def neighbours_before_after(spark, folder):
    return R.order_neighbours(table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("name")))


@query(
    r"""with k as (select distinct lower(p_name) as w from part union select unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]{4,}')) from part),
    q as (select p_partkey as query_id, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_brand || ' ' || p_name || ' ' || 'unseen words'), '[\p{L}\p{N}_]{4,}')) as q from part),
    x as (select query_id, len(q) as n, unnest(q) as w from q)
    select query_id, round(count(*) filter (w not in (select w from k)) / any_value(n), 9) as novelty from x group by 1"""
)
def query_novelty(spark, folder):
    p = table(spark, folder, "part")
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_type", "p_brand", "p_name", F.lit("unseen words")).alias("query"))
    ents = p.select(F.lower("p_name").alias("id"), F.col("p_name").alias("label"))
    return R.novelty_of_query(asked, ents).select("query_id", F.round("novelty", 9).alias("novelty"))


@query()
def deep_recall(spark, folder):
    from .search_queries import memo_paragraphs, nation_questions
    from ..operators.search import search

    asked = nation_questions(spark, folder)
    found = settle(search(memo_paragraphs(spark, folder), asked, F.lit("2024-01-31").cast("date"), k=1))
    m = memo(spark, folder)
    graph = settle(C.counted_graph(m.select("name", F.col("day").alias("date"), "text", T.trace_entities(F.col("text")).alias("entities"))))
    rel = settle(C.relation_table(graph))
    ents = settle(C.entity_table(graph, ["gpu", "pytorch"]))
    memories = m.select(F.col("event_id").alias("item_id"), "text")
    out = R.deep_recall(found.select("query_id", "rank", "name", "score"), asked, memories, ents, rel, m.select("name", "text"))
    j = lambda c: F.array_join(F.col(c), "|").alias(c)
    return out.select("query_id", "trace", "score", j("key_points"), j("entities"), j("related"), j("before"), j("after"), j("cross_project"), F.round("novelty", 6).alias("novelty"))


