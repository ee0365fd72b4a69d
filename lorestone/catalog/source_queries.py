"""Queries that write to stored tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import vectors as V
from ..operators import consolidate as C
from ..session import new_folder
from ..sources import files
from ..sources import vectorlog as G
from ..sources import versions as S
from .base import MEMO_SQL, memo, query, table
from .text_queries import TRACE_ENTITIES_SQL, chain_sql, words_sql
from .trace_queries import count_vector, memo_chunks

_TYPE = chain_sql([(n, words_sql("lower(name)", w)) for n, w in fixed.TRACE_TYPES], "general")


def _memories_sql(name: str, keep: str, today: str) -> str:
    """CTEs that end in the memories of the notes that ``keep`` lets through."""
    return f"""{name}t as (select name, project, day as date, {_TYPE} as type, {TRACE_ENTITIES_SQL.format('text')} as es from {MEMO_SQL} where {keep}),
    {name}g as (select *, case when coalesce(abs(datediff('day', cast(lag(date) over w as date), cast(date as date))), 0) > 2 then 1 else 0 end as s from {name}t window w as (partition by project order by date, name)),
    {name}c as (select *, sum(s) over (partition by project order by date, name) as cluster from {name}g),
    {name}m as (select project, cluster, type, count(*) as n, min(date || name) as a0 from {name}c group by 1, 2, 3),
    {name}y as (select project, cluster, type as main_type from {name}m qualify row_number() over (partition by project, cluster order by n desc, a0) = 1),
    {name}e as (select project, cluster, count(distinct e) as n_entities from (select project, cluster, unnest(es) as e from {name}c) group by 1, 2),
    {name}r as (select case main_type when 'general' then 'findings' else main_type end as category, project, cluster, min(date) as date, any_value(main_type) as main_type, count(*) as n_traces, coalesce(any_value(n_entities), 0) as n_entities
      from {name}c join {name}y using (project, cluster) left join {name}e using (project, cluster) group by 1, 2, 3),
    {name} as (select category, date || '_' || substr(regexp_replace(lower(project || '-' || main_type), '[^a-z0-9_-]', '-', 'g'), 1, 60) || '.md' as memory_id, project, date, n_traces, n_entities, '{today}' as last_validated from {name}r
      qualify row_number() over (partition by category, memory_id order by cluster desc, project desc) = 1)"""


@query(
    f"""with {_memories_sql('ma', "day < '2024-01-15'", '2024-01-15')}, {_memories_sql('mb', 'true', '2024-01-31')}
    select 1 as version, * from ma union all select 2, * from mb union all select 2, * from ma where (category, memory_id) not in (select category, memory_id from mb)"""
)
def memory_versions(spark, folder):
    """Memories written back twice into a versioned table, read as of both versions."""
    path = new_folder(spark)
    m = memo(spark, folder)
    traces = C.analyze_traces(m.select("name", "text", "project")).drop("project").join(m.select("name", "project"), "name")
    for today, part in (("2024-01-15", traces.where("date < '2024-01-15'")), ("2024-01-31", traces)):
        S.merge_rows(spark, path, C.memory_records(C.cluster_traces(part), today), ["category", "memory_id"], "category")
    shown = ["category", "memory_id", "project", "date", "n_traces", "n_entities", "last_validated"]
    first, second = (S.read_version(spark, path, v).select(F.lit(v).alias("version"), *shown) for v in (1, 2))
    return first.unionByName(second)


@query()
def vector_store(spark, folder):
    """Chunks added in two steps, some removed, the log compacted; what the store holds then."""
    path = new_folder(spark)
    chunks = memo_chunks(spark, folder).select("chunk_id", "text", "source", "content_hash")
    G.add(spark, path, chunks.where("source in ('alder', 'birch')"), count_vector)
    G.add(spark, path, chunks, count_vector)
    G.remove(spark, path, chunks.where("source = 'cedar'"))
    G.compact(spark, path)
    return G.vectors(spark, path).select("chunk_id", "source", F.round(V.norm(F.col("embedding")), 2).alias("length"))


_COMMIT_MESSAGE = "concat('Fix ', {0}, ' | part ', {1})"


@query(
    """with c as (select o_orderkey, 'repo' || (o_orderkey % 5) as project, 'Fix ' || o_orderpriority || ' | part ' || o_custkey as message, 'clerk' || (o_custkey % 7) as author, epoch(o_orderdate::timestamp)::bigint as ts, printf('%040x', o_orderkey) as sha from orders),
    s as (select project, ts, sha from c where o_orderkey % 5 < 4 qualify row_number() over (partition by project order by ts, sha) = 100)
    select project || ': ' || message || ' (by ' || author || ')' as text, 'git-' || project as source, project, c.ts as timestamp from c left join s using (project) where s.ts is null or (c.ts, c.sha) > (s.ts, s.sha)"""
)
def commit_stimuli(spark, folder):
    """Commits behind the last seen one of each repository, read from a dump with bodies of several lines."""
    path = new_folder(spark)
    o = table(spark, folder, "orders").select(
        F.expr("concat('repo', o_orderkey % 5)").alias("project"), F.expr("lpad(lower(hex(o_orderkey)), 40, '0')").alias("sha"), F.expr(_COMMIT_MESSAGE.format("o_orderpriority", "o_custkey")).alias("message"),
        F.expr("concat('clerk', o_custkey % 7)").alias("author"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), "o_orderstatus",
    )
    body = F.concat_ws("\n", "o_orderstatus", F.lit(""), F.col("o_orderstatus"))
    dump = F.concat_ws("\x1f", F.concat(F.lit("\x1e"), "sha"), "message", "author", F.col("ts").cast("string"), F.concat("project", F.lit("\n"), body))
    o.select(dump.alias("value")).write.text(path)
    log = files.commit_log(spark, path).withColumn("project", F.substring_index("body", "\n", 1))
    from ..plans.ordered import row_index

    seen = row_index(log.where("project <> 'repo4'"), ["project"], ["ts", "sha"]).where("pos = 100").select("project", "sha")
    fresh, _ = files.new_commits(log, seen)
    return files.commit_stimuli(fresh)
