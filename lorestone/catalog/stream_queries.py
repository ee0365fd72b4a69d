"""Queries that run as Structured Streaming jobs over the tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_folder
from ..streaming import jobs as J
from .base import MEMO, derive, memo, query, table
from .metric_queries import _OT, FEED_SQL, MEMO_SQL


def _fresh(spark, name: str) -> str:
    return f"{new_folder(spark)}/{name}"


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _collect(spark, stream, name: str):
    out = _fresh(spark, name)
    J.run_available(stream, J.batch_sink(out), out + "-cursor")
    return spark.read.option("recursiveFileLookup", True).schema(stream.schema).parquet(out)


@query(
    """with w as (select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2)
    select cast(start as string) as start, event_type, n, round(total, 4) as total from w where start + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)"""
)
def stream_hourly(spark, folder):
    """Hourly counts with a watermark: windows that are complete when the stream ends."""
    out = _collect(spark, J.windowed_counts(event_stream(spark, folder), ["event_type"]), "hourly")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval '30 minutes' then 1 else 0 end as s from events window w as (partition by user_id order by ts)),
    k as (select *, sum(s) over (partition by user_id order by ts) as k from g), c as (select user_id, k, min(ts) as start, max(ts) as last, count(*) as n from k group by 1, 2)
    select user_id, count(*) as sessions, sum(n)::bigint as n from c where last + interval '30 minutes' <= (select max(ts) - interval '10 minutes' from events) group by 1"""
)
def stream_sessions(spark, folder):
    out = _collect(spark, J.session_counts(event_stream(spark, folder), ["user_id"]), "sessions")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query(
    f"""with e as (select event_id, user_id % 10 as agent, epoch_ms(ts) as ts, {_OT.format("body")} as w, {_OT.format("who || ' fixed parser in ' || city || ' shop sold pages'")} as m1, {_OT.format("'measured ' || who || ' fixed bm25 hits'")} as m2 from {MEMO_SQL}),
    u as (select distinct r.event_id from e r join e w on r.event_id % 2 = 0 and w.event_id % 2 = 1 and r.agent = w.agent and w.ts >= r.ts and w.ts - r.ts <= 1800000
      where (len(r.m1) >= 4 and len(list_intersect(r.m1, w.w)) / len(r.m1) >= 0.6) or (len(r.m2) >= 4 and len(list_intersect(r.m2, w.w)) / len(r.m2) >= 0.6))
    select event_id::string as event_id, event_id in (select event_id from u) as was_used from e
      where event_id % 2 = 0 and (len(m1) >= 4 or len(m2) >= 4) and (event_id in (select event_id from u) or ts + 1800000 < (select max(ts) - 600000 from e))"""
)
def stream_outcomes(spark, folder):
    """Recalls that a later text of the same agent echoes, and those whose time ran out, from keyed state and timers."""
    m = derive(event_stream(spark, folder), MEMO).select(
        "event_id", F.expr("user_id % 10").alias("agent"), "ts", "body",
        F.array(F.expr("concat(who, ' fixed parser in ', city, ' shop sold pages')"), F.expr("concat('measured ', who, ' fixed bm25 hits')")).alias("memories"),
    ).withWatermark("ts", "10 minutes")
    both = J.outcome_events(
        m.where("event_id % 2 = 0"), m.where("event_id % 2 = 1").withColumnRenamed("body", "text")
    )
    with J.keyed_state(spark):
        return _collect(spark, J.track_outcomes(both), "outcomes")


def feed_file(spark, folder) -> str:
    """The derived feed as one relay file in line order, with broken lines in between."""
    from .metric_queries import feed

    out = _fresh(spark, "relay")
    row = F.to_json(F.struct("ty", "s", "t", "p", F.col("line_no").cast("string").alias("i"), "h"))
    line = F.when(F.col("line_no") % 11 == 0, F.concat(F.lit("{"), row)).when(F.col("line_no") % 13 == 0, F.concat(F.lit("["), row, F.lit("]"))).otherwise(row)
    # a relay file has one writer
    feed(spark, folder).select("line_no", line.alias("value")).repartition(1).sortWithinPartitions("line_no").select("value").write.text(out)
    return spark.read.text(out).inputFiles()[0]


@query(
    f"""with f as ({FEED_SQL}), k as (select *, replace(ty, '-', '_') as kind, regexp_matches(p, '(?i)^\\s*(?:\\[(finding|key finding|decision|decision point)\\]|(finding|key finding|decision|decision point))\\s*:\\s*(.+?)\\s*$') as m,
      trim(regexp_extract(p, '(?is)^\\s*(?:\\[(?:finding|key finding|decision|decision point)\\]|(?:finding|key finding|decision|decision point))\\s*:\\s*(.+?)\\s*$', 1)) as st from f),
    r as (select line_no, case when line_no % 11 = 0 then 'invalid JSON: Expecting property name enclosed in double quotes' when line_no % 13 = 0 then 'feed row must be a JSON object' end as reason,
      case when m then st when kind in ('finding', 'decision_point') then trim(p) else '' end as statement from k)
    select line_no, case when reason is not null then 'rejected' when statement <> '' then 'admitted' else 'skipped' end as status, reason, case when reason is null and statement <> '' then statement end as statement
      from r where reason is not null or statement <> ''"""
)
def feed_intake(spark, folder):
    """Lines of a relay file that were admitted or rejected, read in two passes with a cursor in between."""
    path, out = feed_file(spark, folder), _fresh(spark, "intake")
    for limit in (1000, None):
        J.ingest_lines(spark, path, out, out + "-checkpoint", out + "-cursor", limit)
    read = lambda name: spark.read.option("recursiveFileLookup", True).parquet(f"{out}/{name}")
    found = read("finding").select("line_no", F.lit("admitted").alias("status"), F.lit(None).cast("string").alias("reason"), "statement")
    lost = read("reject").select("line_no", F.lit("rejected").alias("status"), "reason", F.lit(None).cast("string").alias("statement"))
    return found.unionByName(lost)


@query()
def stream_feed(spark, folder):
    """Feed rows written as line files, then ingested through the stream."""
    from .metric_queries import feed

    src, out = _fresh(spark, "feed-in"), _fresh(spark, "feed-out")
    rows = feed(spark, folder)
    text = rows.select(F.to_json(F.struct("ty", "s", "t", "p", F.col("line_no").cast("string").alias("i"), "h")).alias("value"))
    text.write.text(src)
    J.run_available(J.feed_stream(spark, src, "*.txt"), J.batch_sink(out, J.admitted), out + "-cursor")
    found = spark.read.option("recursiveFileLookup", True).parquet(out)
    return found.select("line_no", "statement", "subkind", "path")


@query()
def stream_observer(spark, folder):
    """Memo texts as watched files, turned into notes by the stream."""
    src, out = _fresh(spark, "watch-in"), _fresh(spark, "watch-out")
    m = memo(spark, folder).select("text")
    # one file per writer task; the watcher sees each as one document
    m.repartition(8).write.text(src)
    stream = J.watched_stream(spark, src, "*.txt")
    J.run_available(stream, J.batch_sink(out), out + "-cursor")
    found = spark.read.option("recursiveFileLookup", True).parquet(out)
    return found.select("content").distinct()
