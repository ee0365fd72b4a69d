"""Dated events: extraction, edges, queries, cyclic resonance and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.answers import months_apart
from ..functions.common import contains_any, extract_all, let, overlap, strip
from ..plans.dyadic import pieces, stored_tops
from ..plans.scale import top_per_key
from ..session import settle
from .index import unnest

WORD = r"[a-z0-9]{3,}"


def extract_events(documents: DataFrame, ref: Column) -> DataFrame:
    """(source, paragraph_idx, date, text) of every date in every sentence.

    ``documents`` has name and text; relative expressions are resolved against ``ref`` and
    annotated in the text.
    """
    text = D.annotate_vague_dates(F.col("text"), ref)
    rows = documents.select(
        F.col("name").alias("source"), ref.alias("_ref"),
        F.posexplode_outer(D.event_sentences(text)).alias("paragraph_idx", "_s"),
    )
    return rows.select(
        "source", "paragraph_idx", unnest(D.event_dates(F.col("_s"), F.col("_ref")), "date"),
        F.substring(strip(F.col("_s")), 1, 200).alias("text"),
    ).where("date is not null")


def date_edges(events: DataFrame, per_date: int = 3) -> DataFrame:
    """(src, dst, relation, src_date, dst_date).

    ``same_day`` is an equivalence, so each day is a star: its first event points to every other
    event of the day, and two events are on the same day exactly when they share that centre.
    ``before`` links the first three events of a day with the first three of the next day present.
    """
    first = events.groupBy("date").agg(F.min("event_id").alias("src"))
    same = events.join(first, "date").where("event_id <> src").select(
        "src", F.col("event_id").alias("dst"), F.lit("same_day").alias("relation"),
        F.col("date").alias("src_date"), F.col("date").alias("dst_date"),
    )
    # distinct dates are bounded by the calendar
    step = first.select("date", F.lead("date").over(W.orderBy("date")).alias("next"))
    head = top_per_key(events.select("event_id", "date"), ["date"], [F.asc("event_id")], per_date).drop("rank")
    before = (
        head.withColumnRenamed("event_id", "src").join(step.where("next is not null"), "date")
        .join(head.select(F.col("event_id").alias("dst"), F.col("date").alias("next")), "next")
        .select("src", "dst", F.lit("before").alias("relation"), F.col("date").alias("src_date"), F.col("next").alias("dst_date"))
    )
    return same.unionByName(before)


def same_day(events: DataFrame, of: DataFrame) -> DataFrame:
    """All events on the days of the given events: the expanded form for a few of them."""
    return of.select(F.col("event_id").alias("src"), "date").join(
        events.select(F.col("event_id").alias("dst"), "date"), "date"
    ).where("src <> dst")


def question_range(queries: DataFrame, ref: Column) -> DataFrame:
    """(query_id, q, dated, low, high): the dates that a question asks for, null where a side is open."""
    asked = queries.select("query_id", F.lower("query").alias("q"), D.parse_dates(F.col("query"), ref).alias("dates"))
    n, first, second = F.size("dates"), F.get("dates", F.lit(0)), F.get("dates", F.lit(1))
    later, earlier = contains_any(F.col("q"), ["after", "since"]), contains_any(F.col("q"), ["before", "until"])
    return asked.select(
        "query_id", "q", (n > 0).alias("dated"),
        F.when((n > 0) & later, first).when((n > 1) & ~earlier, first).alias("low"),
        F.when((n > 0) & ~later & earlier, first).when((n > 1) & ~later, second).alias("high"),
    )


def date_index(events: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(dates, tops, levels): places of the dates present, and for each dyadic range of them the first k events.

    ``tops`` has kind ``newest``, ``oldest`` or ``any`` (smallest event_id).  Within a date all three take
    the smallest ids, so a date with any number of events gives k rows to the levels above.
    """
    # the dates present are bounded by the calendar
    dates = settle(events.groupBy("date").agg(F.lit(0).alias("_")).select("date", (F.row_number().over(W.orderBy("date")) - 1).cast("long").alias("place")))
    count = dates.count()
    levels = max(count - 1, 0).bit_length()
    head = settle(top_per_key(events.select("event_id", "date"), ["date"], [F.asc("event_id")], k).drop("rank").join(dates, "date"))
    orders = {
        "newest": [F.desc("place"), F.asc("event_id")], "oldest": [F.asc("place"), F.asc("event_id")], "any": [F.asc("event_id")],
    }
    return dates, settle(stored_tops(head, "place", levels, orders, k)), levels


def query_events(events: DataFrame, queries: DataFrame, ref: Column, k: int = 5) -> DataFrame:
    """(query_id, event_id, date, overlap, rank): events by word overlap inside the asked dates.

    after/since, before/until and two dates bound the range; a question with dates also returns
    events without a shared word.  Newest and oldest questions are ordered by date.

    Events with a shared word come through the words.  Of the others a question needs at most k, the first of its range by
    its own order, and these are stored for dyadic ranges of dates: whoever is ahead of such an event by date and id is ahead of
    it with shared words too.
    """
    asked = settle(question_range(queries, ref))
    words = asked.select("query_id", "low", "high", unnest(F.array_distinct(extract_all(F.col("q"), WORD)), "token")).where("token is not null")
    held = events.select("event_id", "date", unnest(F.array_distinct(extract_all(F.lower("text"), WORD)), "token"))
    hits = held.where("token is not null").join(words, "token").where("(low is null or date >= low) and (high is null or date <= high)")
    hits = hits.groupBy("query_id", "event_id").agg(F.first("date").alias("date"), F.count("*").alias("overlap"))
    newest = contains_any(F.col("q"), ["latest", "recent", "last", "newest"])
    oldest = contains_any(F.col("q"), ["first", "earliest", "oldest", "original"])
    dates, tops, levels = date_index(events, k)
    # one row with the dates present
    known = dates.agg(F.array_sort(F.collect_list("date")).alias("known")).withColumn("one", F.lit(1))
    low = F.when(F.col("low").isNull(), 0).otherwise(F.size(F.filter("known", lambda d: d < F.col("low"))))
    end = F.when(F.col("high").isNull(), F.size("known")).otherwise(F.size(F.filter("known", lambda d: d <= F.col("high"))))
    wanted = asked.where("dated").withColumn("one", F.lit(1)).join(known, "one").select(
        "query_id", F.when(newest, "newest").when(oldest, "oldest").otherwise("any").alias("kind"), F.inline(pieces(low, end, levels)),
    )
    near = tops.join(wanted, ["kind", "level", "node"]).select("query_id", "event_id", "date").join(
        hits.select("query_id", "event_id"), ["query_id", "event_id"], "left_anti"
    )
    rows = hits.unionByName(near.withColumn("overlap", F.lit(0).cast("long"))).join(asked.select("query_id", "q"), "query_id")
    order = [
        F.desc(F.when(newest, F.col("date"))), F.asc(F.when(oldest & ~newest, F.col("date"))),
        F.desc("overlap"), F.asc("event_id"),
    ]
    return top_per_key(rows, ["query_id"], order, k).drop("q")


def resonance(events: DataFrame, query_date: Column, tolerance: float = 0.01) -> DataFrame:
    """Events whose yearly phase is close to that of a date, with the cosine of the difference."""
    value = F.cos(D.date_phase(F.to_date("date")) - D.date_phase(query_date))
    return events.withColumn("resonance", value).where(F.col("resonance") >= 1.0 - tolerance)


def _event_score(text: Column, words: Column, pairs: Column) -> Column:
    tokens = extract_all(F.lower(text), r"[a-z]{3,}")

    def score(t):
        n = F.size(t)
        grams = F.when(
            n >= 2,
            F.array_distinct(F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))),
        ).otherwise(F.array().cast("array<string>"))
        common = overlap(words, t)
        return F.when(n == 0, 0.0).otherwise(
            common + 2.0 * overlap(pairs, grams) + 0.3 * common / F.sqrt(F.greatest(n, F.lit(1)))
        )

    return let(tokens, score)


def temporal_answer(query: Column, events: Column, today: Column) -> Column:
    """Answer by date arithmetic over array<struct<date:string,text:string>>, NULL when none fits.

    The array holds the dated events of a result list, so it is short.
    """
    q = F.lower(query)
    parsed = F.filter(
        F.transform(events, lambda e: F.struct(F.try_to_date(e["date"], "yyyy-MM-dd").alias("day"), e["text"].alias("text"))),
        lambda e: e["day"].isNotNull(),
    )
    iso = lambda d: d.cast("string")

    def span(p):
        tokens = extract_all(q, r"[a-z]{3,}")

        def with_tokens(t):
            n = F.size(t)
            pairs = F.when(
                n >= 2, F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
            ).otherwise(F.array().cast("array<string>"))
            scored = F.array_sort(
                F.transform(p, lambda e, i: F.struct((-_event_score(e["text"], t, pairs)).alias("r"), i.alias("i"), e["day"].alias("day")))
            )

            def ends(s):
                a, b = F.get(s, F.lit(0)), F.get(s, F.lit(1))
                near = (a["r"] < 0) & (b["r"] < 0) & (a["day"] != b["day"])
                days = F.transform(s, lambda x: x["day"])
                return F.struct(
                    F.when(near, F.least(a["day"], b["day"])).otherwise(F.array_min(days)).alias("d1"),
                    F.when(near, F.greatest(a["day"], b["day"])).otherwise(F.array_max(days)).alias("d2"),
                )

            return let(scored, ends)

        return let(let(tokens, with_tokens), duration)

    def duration(e):
        d1, d2 = e["d1"], e["d2"]
        n = F.datediff(d2, d1)
        tail = F.format_string(" (%d days exclusive, %d inclusive, from %s to %s)", n, n + 1, iso(d1), iso(d2))
        weeks = F.when(n % 7 == 0, F.format_string("%d weeks", F.floor(n / 7))).otherwise(
            F.format_string("%d weeks and %d days", F.floor(n / 7), n % 7)
        )
        return (
            F.when(q.contains("week"), F.concat(weeks, tail))
            .when(q.contains("month"), F.concat(F.format_string("%d months", months_apart(d1, d2)), tail))
            .otherwise(F.format_string("%d days (or %d days counting both endpoints, from %s to %s)", n, n + 1, iso(d1), iso(d2)))
        )

    def counted(p):
        words = F.array_distinct(extract_all(q, r"[a-z]{3,}"))
        hit = F.filter(p, lambda e: F.arrays_overlap(words, extract_all(F.lower(e["text"]), r"[a-z]{3,}")))
        days = F.array_sort(F.array_distinct(F.transform(hit, lambda e: iso(e["day"]))))
        return let(
            days,
            lambda d: F.when(F.size(d) > 0, F.format_string("%d times (on %s)", F.size(d), F.array_join(d, ", "))),
        )

    def order(p):
        a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        n = F.datediff(b["day"], a["day"])
        ta, tb = F.substring(a["text"], 1, 60), F.substring(b["text"], 1, 60)
        return (
            F.when(n > 0, F.format_string("%s happened before %s (%d days earlier)", ta, tb, n))
            .when(n < 0, F.format_string("%s happened after %s (%d days later)", ta, tb, -n))
            .otherwise(F.concat(F.lit("Both happened on the same day: "), iso(a["day"])))
        )

    def extreme(p, sign):
        ranked = F.array_sort(
            F.transform(p, lambda e, i: F.struct((sign * F.unix_date(e["day"])).alias("r"), i.alias("i"), e["day"].alias("day"), e["text"].alias("text")))
        )
        return let(ranked, lambda r: F.get(r, F.lit(0)))

    def named(e):
        return F.format_string("%s (%s)", F.substring(e["text"], 1, 100), iso(e["day"]))

    def since(e):
        n = F.datediff(today, e["day"])
        tail = F.format_string(" (%d days, or %d inclusive) since %s (%s)", n, n + 1, F.substring(e["text"], 1, 60), iso(e["day"]))
        return (
            F.when(q.contains("week"), F.concat(F.format_string("%d weeks", F.floor(n / 7)), tail))
            .when(q.contains("month"), F.concat(F.format_string("%d months", months_apart(e["day"], today)), tail))
            .otherwise(F.format_string("%d days (or %d inclusive) since %s (%s)", n, n + 1, F.substring(e["text"], 1, 60), iso(e["day"])))
        )

    def answer(p):
        n = F.size(p)
        times = contains_any(q, ["how many times", "how often"]) | (
            q.startswith("how many ") & q.rlike(r"(?:^|.* )did(?: |$)") & ~q.contains("ago")
        )
        return (
            F.when(n == 0, F.lit(None))
            .when(q.rlike("how (?:long|many days|many weeks|many months)") & (n >= 2), span(p))
            .when(times & counted(p).isNotNull(), counted(p))
            .when(q.contains("before") & q.contains("after") & (n >= 2), order(p))
            .when(contains_any(q, ["most recent", "latest", "last", "newest"]), let(extreme(p, -1), named))
            .when(contains_any(q, ["first", "earliest", "oldest"]), let(extreme(p, 1), named))
            .when(q.rlike("since|ago|how long"), let(extreme(p, -1), since))
        )

    return let(parsed, answer)


