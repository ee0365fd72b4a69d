"""Skylines, dyadic ranges, block bounds, feed source and keyed state against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorestone.operators import blockindex as B
from lorestone.operators import index as I
from lorestone.operators import metrics as M
from lorestone.operators import search as S
from lorestone.operators import temporal as E
from lorestone.plans.dyadic import pieces
from lorestone.plans.skyline import skyline
from lorestone.streaming import jobs as J


def brute_skyline(points):
    """Undominated rows of distinct (x, y, -z), by a sweep over falling x."""
    out = set()
    for p in points:
        if not any(q != p and q[0] >= p[0] and q[1] >= p[1] and q[2] <= p[2] for q in points):
            out.add(p)
    return out


@pytest.mark.parametrize("size", [4, 25, 10_000])
def test_skyline_equals_brute_force(spark, size):
    rng = random.Random(size)
    groups = {
        "grid": [(float(rng.randint(0, 6)), float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(200)],
        "free": [(rng.random(), rng.random(), rng.random()) for _ in range(200)],
        "flat": [(1.0, float(rng.randint(0, 40)), float(rng.randint(0, 40))) for _ in range(100)],
        None: [(1.0, 1.0, 1.0)] * 5,
    }
    rows = [(g, *p) for g, points in groups.items() for p in points]
    got = {tuple(r) for r in skyline(spark.createDataFrame(rows, "grp string, x double, y double, z double"), size).collect()}
    assert got == {(g, *p) for g, points in groups.items() for p in brute_skyline(set(points))}


def test_a_frontier_of_all_points(spark):
    n = 100_000
    x = np.arange(n, dtype=float)
    base = spark.range(n).select("id", F.lit("b").alias("benchmark"), F.col("id").cast("double").alias("x"))
    # nobody is better in accuracy and latency at once
    points = base.select("id", "benchmark", (F.col("x") + 1).alias("accuracy"), F.lit(100).alias("tokens_total"), (F.col("x") * 2).alias("p95_latency_ms"))
    worse = points.where("id % 1000 = 7").select((F.col("id") + n).alias("id"), "benchmark", (F.col("accuracy") - 0.5).alias("accuracy"), "tokens_total", (F.col("p95_latency_ms") + 0.5).alias("p95_latency_ms"))
    got = M.pareto_frontier(points.unionByName(worse).withColumn("z", F.lit("own")), size=3000)
    assert got.where("frontier").count() == len(x) and got.where("not frontier").agg(F.min("id")).first()[0] == n + 7
    assert got.where("z = 'own'").count() == n + n // 1000


def test_ranges_are_made_of_their_pieces(spark):
    rows = [(a, b) for a in range(0, 17) for b in range(0, 18)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", pieces(F.col("a"), F.col("b"), 5).alias("p")).collect()
    for r in got:
        covered = [i for q in r.p for i in range(q["node"] << q["level"], (q["node"] + 1) << q["level"])]
        assert sorted(covered) == list(range(r.a, r.b)) and len(r.p) <= 10


DAYS = [f"2024-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in range(1, 29)]


def dated(rng, n):
    words = ["launch", "review", "budget", "parser", "trip", "move"]
    return [(i, rng.choice(DAYS[: 60]), " ".join(rng.choice(words) for _ in range(3))) for i in rng.sample(range(1000), n)]


def brute_temporal(events, query, k):
    import re

    q = query.lower()
    dates = sorted(set(re.findall(r"\d{4}-\d{2}-\d{2}", q)))
    if dates:
        if "after" in q or "since" in q:
            events = [e for e in events if e[1] >= dates[0]]
        elif "before" in q or "until" in q:
            events = [e for e in events if e[1] <= dates[0]]
        elif len(dates) >= 2:
            events = [e for e in events if dates[0] <= e[1] <= dates[1]]
    words = set(re.findall("[a-z0-9]{3,}", q))
    rows = [(e, len(words & set(re.findall("[a-z0-9]{3,}", e[2].lower())))) for e in sorted(events)]
    rows = [(e, n) for e, n in rows if n or dates]
    if any(w in q for w in ("latest", "recent", "last", "newest")):
        rows.sort(key=lambda r: (-r[1], r[0][0]))
        rows.sort(key=lambda r: r[0][1], reverse=True)
    elif any(w in q for w in ("first", "earliest", "oldest", "original")):
        rows.sort(key=lambda r: (r[0][1], -r[1], r[0][0]))
    else:
        rows.sort(key=lambda r: (-r[1], r[0][0]))
    return [(e[0], n) for e, n in rows[:k]]


def test_temporal_queries_equal_the_rule(spark):
    rng = random.Random(5)
    events = dated(rng, 150)
    asked = ["budget since 2024-01-20", "latest parser after 2024-02-05", "first trip before 2024-02-02", "unknown thing until 2024-01-03", "moves between 2024-01-05 and 2024-01-09",
             "latest since 2024-03-25", "earliest of 2024-02-01", "newest review", "no word here", "oldest after 2023-01-01", "launch 2024-01-15"]
    df = spark.createDataFrame(events, "event_id long, date string, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    for k in (1, 5, 40):
        got = {}
        for r in E.query_events(df, queries, F.lit("2024-04-01").cast("date"), k).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.event_id, r.overlap)
        for i, q in enumerate(asked):
            mine = got.get(i, {})
            assert [mine[j + 1] for j in range(len(mine))] == brute_temporal(events, q, k), (q, k)
    assert E.query_events(df.limit(0), queries, F.lit("2024-04-01").cast("date"), 5).count() == 0


def units(spark, rng, n):
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(["launch", "review", "budget", "parser", "trip", "notes"]) for _ in range(6)) + f" on {DAYS[i % 60]}"
        rows.append((i * 10, i, 0, text, f"doc{i}.md", "alder", f"notes/doc{i}.md", DAYS[i % 60], "note", "discussion"))
    return spark.createDataFrame(rows, "para_id long, doc_id long, para_idx int, text string, name string, source string, path string, date string, doc_type string, para_type string")


def test_dated_events_are_put_in_front(spark):
    rng = random.Random(8)
    paragraphs = units(spark, rng, 40)
    queries = spark.createDataFrame([(1, "When did the budget review happen since 2024-01-10?"), (2, "What is the parser?")], "query_id long, query string")
    ref = F.lit("2024-04-01").cast("date")
    plain = S.search(paragraphs, queries, ref, k=3).collect()
    first = [r.name for r in sorted(plain, key=lambda r: r["rank"]) if r.query_id == 1]
    # the first event is of a document that is found already, the second has none, the third is new, and named twice
    new = next(n for n in ("doc30.md", "doc31.md", "doc32.md", "doc33.md") if n not in first)
    events = [(1, first[0], "2024-02-01", "budget review happen since"), (2, "gone.md", "2024-02-01", "budget review happen did"), (3, new, "2024-02-02", "budget review happen")]
    df = spark.createDataFrame(events, "event_id long, source string, date string, text string")
    got = S.search(paragraphs, queries, ref, k=3, events=df).collect()
    names = [r.name for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1]
    assert names == [new, *first[:2]]
    assert [r.score for r in got if r.name == new and r.query_id == 1] == [2.0]
    assert {r.name for r in got if r.query_id == 2} == {r.name for r in plain if r.query_id == 2}


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_block_search_equals_scoring_everything(spark, tmp_path, width):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.choice([0, 4, 30])))) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(15)]
    paragraphs = spark.createDataFrame(rows, "para_id long, text string")
    queries = spark.createDataFrame([(1, "word0 word1 word50"), (2, "word40 word41"), (3, "none here"), (4, rows[5][1]), (5, "word59")], "query_id long, query string")
    pick = lambda df: sorted((r.query_id, r["rank"], r.para_id, round(r.score, 9)) for r in df.collect())
    B.write_blocks(paragraphs, str(tmp_path / "index"), width=width, buckets=3)
    top, report = B.search_blocks(spark, str(tmp_path / "index"), queries, 7)
    assert pick(top) == pick(I.bm25_top(paragraphs, queries, 7))
    counts = {r.query_id: (r.n_blocks, r.n_scored) for r in report.collect()}
    assert all(b <= a for a, b in counts.values()) and (width != 1 or counts[4][1] < counts[4][0])
    gone = spark.createDataFrame([(r.para_id,) for r in top.where("query_id = 4").collect()], "para_id long")
    left, _ = B.search_blocks(spark, str(tmp_path / "index"), queries, 7, removed=gone)
    kept = F.col("para_id").isin([r.para_id for r in gone.collect()])
    assert pick(left) == pick(I.bm25_top(paragraphs, queries, 7, candidates=~kept))


def feed_row(i, text):
    return json.dumps({"ty": "chat", "s": "alder/worker", "t": "1700000000", "p": text, "i": "7", "h": "Host"})


def test_feed_survives_restarts_without_loss_or_repeats(spark, tmp_path):
    path, out = tmp_path / "feed.ndjson", str(tmp_path / "out")
    lines = [feed_row(i, f"Finding: number {i} is ä") if i % 3 else feed_row(i, "chatter") for i in range(1, 31)]
    lines[4], lines[9], lines[14] = "{broken", "[1, 2]", ""
    path.write_text("\n".join(lines[:20]) + "\n" + lines[20][:10], encoding="utf-8")
    ingest = lambda limit=None: J.ingest_lines(spark, str(path), out, out + "-checkpoint", out + "-cursor", limit)
    read = lambda name: spark.read.option("recursiveFileLookup", True).parquet(f"{out}/{name}").collect()
    ingest(limit=7)
    assert json.loads((tmp_path / "out-cursor").read_text())["line"] == 7
    ingest()
    assert json.loads((tmp_path / "out-cursor").read_text())["line"] == 20
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    ingest()
    ingest()
    found, lost, report = read("finding"), read("reject"), read("report")
    want = [i for i in range(1, 31) if i % 3 and i not in (5, 10, 15)]
    assert sorted((r.line_no, r.statement) for r in found) == [(i, f"number {i} is ä") for i in want]
    assert sorted((r.line_no, r.reason.split(":")[0]) for r in lost) == [(5, "invalid JSON"), (10, "feed row must be a JSON object"), (15, "invalid JSON")]
    assert sum(r.scanned for r in report) == 30 and sum(r.admitted for r in report) == len(want) == sum(r.candidates for r in report)
    # a new query without a checkpoint starts behind the cursor
    path.write_text("\n".join([*lines, feed_row(31, "Finding: the last one")]) + "\n", encoding="utf-8")
    again = str(tmp_path / "again")
    J.ingest_lines(spark, str(path), again, again + "-checkpoint", out + "-cursor")
    assert [r.line_no for r in spark.read.option("recursiveFileLookup", True).parquet(f"{again}/finding").collect()] == [31]


def test_a_strict_contract_rejects_breaches(spark):
    rows = [(1, json.dumps({"ty": "finding", "s": "", "t": "", "p": "a statement without a time", "h": ""}), None), (2, feed_row(2, "Finding: all of it is there"), None)]
    df = spark.createDataFrame(rows, "line_no long, value string, problem string")
    from lorestone.operators import ledger as L

    loose = {r.line_no: (r.status, r.violations) for r in L.feed_verdicts(df).collect()}
    assert loose[1] == ("admitted", ["missing_actor", "missing_timestamp"]) and loose[2] == ("admitted", [])
    strict = {r.line_no: r.status for r in L.feed_verdicts(df, strict=True).collect()}
    assert strict == {1: "rejected", 2: "admitted"}


def test_many_pending_recalls_are_kept_until_their_time(spark, tmp_path):
    base = 1_700_000_000
    own = lambda i: f"m{i}a m{i}b m{i}c m{i}d m{i}e"
    recalls = [(f"r{i}", "a", base + i, ["too short", own(i)]) for i in range(600)]
    recalls += [("late", "a", base + 8000, [own(700)]), ("short", "a", base, ["one two"]), ("other", "b", base, [own(0)])]
    # three of five words are an echo; the time of number 100 is over at the third text, that of number 200 is not
    writes = [("a", base + 601, "the m0a m0b m0e"), ("a", base + 601, "m599a of m599b m599c m1a m1b"), ("a", base + 1905, f"{own(100)} {own(200)}"), ("a", base + 9000, "unrelated words")]
    src = tmp_path / "src"
    both = spark.createDataFrame([(e, a, t, m, None) for e, a, t, m in recalls] + [(None, a, t, None, x) for a, t, x in writes], "event_id string, agent string, s long, memories array<string>, text string")
    both.withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src)).withWatermark("ts", "1 minute")
    events = J.outcome_events(stream.where("event_id is not null"), stream.where("event_id is null"), shards=1)
    out = str(tmp_path / "out")
    with J.keyed_state(spark):
        J.run_available(J.track_outcomes(events), J.batch_sink(out), out + "-checkpoint")
    got = spark.read.option("recursiveFileLookup", True).parquet(out).collect()
    found = {r.event_id: r.was_used for r in got}
    assert len(got) == len(found)
    used = {"r0", "r599", "r200"}
    assert found == {**{f"r{i}": f"r{i}" in used for i in range(600)}, "other": False}


def test_equal_memories_wait_as_one_and_leave_in_time():
    waiting = J.Waiting(1000, 0.6)
    memory = frozenset("anna fixed parser in riga".split())
    for i in range(500):
        waiting.add(i * 10, f"r{i}", memory)
    assert len(waiting.by_memory) == 1
    # those before 3000 are over, and nothing waits once it was echoed
    assert sorted(at for at, _ in waiting.echoed(4000, "anna fixed it in riga")) == list(range(3000, 5000, 10))
    assert not waiting.by_memory and not waiting.index
    # memories that no text echoes are not looked at for ever
    for i in range(50):
        waiting.add(5000 + i, f"s{i}", frozenset({f"a{i}", f"b{i}", f"c{i}", "parser"}))
    assert waiting.echoed(7000, "parser") == [] and not waiting.by_memory and not waiting.line


def test_recalls_of_an_earlier_batch_wait_in_their_slice(spark, tmp_path):
    base = 1_700_000_000
    own = lambda i: f"m{i}a m{i}b m{i}c m{i}d m{i}e"
    src = tmp_path / "src"
    rows = [
        [(f"r{i}", "a", base + i, [own(i)], None) for i in range(40)],
        # the time of r0 to r4 is over; a second recall of one id counts for nothing while the first waits
        [(None, "a", base + 1805, None, " ".join(own(i) for i in (2, 7, 9))), ("r8", "a", base + 1800, [own(50)], None), (None, "a", base + 1806, None, own(50))],
        [(None, "a", base + 20_000, None, "unrelated")],
    ]
    for part in rows:
        both = spark.createDataFrame(part, "event_id string, agent string, s long, memories array<string>, text string")
        both.withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src)).withWatermark("ts", "1 minute")
    events = J.outcome_events(stream.where("event_id is not null"), stream.where("event_id is null"), shards=2)
    out = str(tmp_path / "out")
    with J.keyed_state(spark):
        J.run_available(J.track_outcomes(events), J.batch_sink(out), out + "-checkpoint")
    got = spark.read.option("recursiveFileLookup", True).parquet(out).collect()
    assert sorted((r.event_id, r.was_used) for r in got) == sorted((f"r{i}", i in (7, 9)) for i in range(40))
