"""Streaming jobs: feeds, watched files, outcome tracking, windows, periodic upkeep.

Cursors are the checkpoints of Structured Streaming.  Sinks write one folder per micro-batch and
overwrite it when a batch is run again, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import schemas
from ..functions import text as T
from ..operators import ledger as L
from ..operators import notes as N
from ..session import settle
from .feed_source import feed_lines, save_cursor


def batch_sink(path: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer into ``path/batch=N``."""

    def write(batch: DataFrame, number: int) -> None:
        out = batch if prepare is None else prepare(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there now and stop."""
    query = (
        stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


# ---- feeds --------------------------------------------------------------------------------------------


def feed_stream(spark: SparkSession, folder: str, glob: str = "*.ndjson") -> DataFrame:
    """Feed rows of newly arriving files; the event number of the row stands for its line."""
    lines = spark.readStream.option("pathGlobFilter", glob).text(folder)
    r = F.from_json("value", schemas.FEED)
    return lines.select(r.alias("r")).where("r is not null").select("r.*").withColumn(
        "line_no", F.coalesce(F.col("i").try_cast("long"), F.lit(0))
    )


def admitted(batch: DataFrame) -> DataFrame:
    """Findings of a feed batch that may enter, under their idempotent path."""
    found = L.admit(L.feed_findings(batch)).where("rejection is null").drop("rejection")
    return found.withColumn("path", L.finding_path(F.col("subkind"), F.col("statement"))).dropDuplicates(["path"])


def ingest_feed(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    run_available(feed_stream(spark, folder), batch_sink(out, admitted), checkpoint)


def ingest_lines(
    spark: SparkSession, path: str, out: str, checkpoint: str, cursor: str | None = None, limit: int | None = None, strict: bool = False
) -> None:
    """One pass over the new lines of a feed file.

    Below ``out``, ``finding`` gets the admitted findings, ``reject`` each rejected line with its reason, ``report`` the counts of the
    batch.  A batch that runs again overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        verdicts = settle(L.feed_verdicts(batch, strict=strict))
        found = verdicts.where("status = 'admitted'").drop("status", "reason")
        found = found.withColumn("path", L.finding_path(F.col("subkind"), F.col("statement")))
        n = lambda c: F.count_if(c).alias
        status = F.col("status")
        report = verdicts.agg(
            F.count("*").alias("scanned"), n(F.col("statement") != "")("candidates"),
            n(status == "admitted")("admitted"), n(status == "skipped")("skipped"), n(status == "rejected")("rejected"),
            n(F.size("violations") > 0)("quarantined"), F.max("line_no").alias("last_line"),
        )
        for name, rows in (("finding", found), ("reject", verdicts.where("status = 'rejected'").select("line_no", "reason", "producer")), ("report", report)):
            batch_sink(f"{out}/{name}")(rows, number)

    query = run_available(feed_lines(spark, path, cursor, limit), write, checkpoint)
    ends = [json.loads(p.json)["sources"][0]["endOffset"] for p in query.recentProgress]
    ends = [json.loads(e) if isinstance(e, str) else e for e in ends if e]
    if cursor and ends:
        save_cursor(cursor, ends[-1])


# ---- watched files ----------------------------------------------------------------------------------------


def watched_stream(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(source, modified, content): note-worthy paragraphs of new and changed files."""
    files = (
        spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .text(folder)
    )
    return files.select(
        F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_modification_time").alias("modified"),
        F.explode(T.watched_paragraphs(F.col("value"))).alias("content"),
    )


def observe(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Turn watched paragraphs into notes."""

    def to_notes(batch: DataFrame) -> DataFrame:
        return N.make_notes(batch.select(F.xxhash64("source", "content").alias("seq"), "content", "source"))

    run_available(watched_stream(spark, folder), batch_sink(out, to_notes), checkpoint)


# ---- outcomes -----------------------------------------------------------------------------------------------


def outcome_events(recalls: DataFrame, writes: DataFrame, shards: int = 4) -> DataFrame:
    """One stream of both sides, spread over ``shards`` groups per agent.

    A recall goes to one shard, a text to all of them, so the pending recalls of a busy agent are
    held by several tasks.
    """
    # tokens hold no blanks, and one string is far smaller in a task than a list of its words
    joined = lambda c: F.concat_ws(" ", L.outcome_tokens(c))
    left = recalls.select(
        "agent", F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard"), "ts", F.unix_millis("ts").alias("at"), F.col("event_id").cast("string").alias("event_id"),
        F.transform("memories", joined).alias("memories"), F.lit(None).cast("string").alias("words"),
    )
    # the words of a text are found once, then dealt to the shards
    right = writes.select("agent", "ts", joined(F.col("text")).alias("words")).select(
        "agent", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ts", F.unix_millis("ts").alias("at"), F.lit(None).cast("string").alias("event_id"),
        F.lit(None).cast("array<string>").alias("memories"), "words",
    )
    return left.unionByName(right)


def _outcomes(names: list[str], used: bool) -> pd.DataFrame:
    return pd.DataFrame({"event_id": pd.Series(names, dtype=object), "was_used": pd.Series([used] * len(names), dtype=object)})


class Waiting:
    """Recalls that a text may still echo, by the tokens of a memory; rows are to come in the order of their time.

    Equal memories wait as one, so a text looks at each memory once however many recalls hold it, and a recall leaves
    when its time is over, so nothing is looked at that can no longer match.
    """

    def __init__(self, ttl: int, share: float) -> None:
        self.ttl, self.share = ttl, share
        self.line: deque[tuple[int, str, frozenset[str]]] = deque()
        self.by_memory: dict[frozenset[str], deque[tuple[int, str]]] = {}
        self.index: dict[str, set[frozenset[str]]] = defaultdict(set)

    def _tokens(self, memory: frozenset[str]) -> list[str]:
        """An echo misses few tokens of a memory, so it holds one of the longest ``n - ceil(share n) + 1``."""
        return sorted(memory, key=lambda t: (-len(t), t))[: len(memory) - math.ceil(self.share * len(memory) - 1e-9) + 1]

    def _forget(self, memory: frozenset[str]) -> None:
        del self.by_memory[memory]
        for token in self._tokens(memory):
            self.index[token].discard(memory)
            if not self.index[token]:
                del self.index[token]

    def add(self, at: int, name: str, memory: frozenset[str]) -> None:
        if memory not in self.by_memory:
            self.by_memory[memory] = deque()
            for token in self._tokens(memory):
                self.index[token].add(memory)
        self.by_memory[memory].append((at, name))
        self.line.append((at, name, memory))

    def echoed(self, now: int, words: str) -> list[tuple[int, str]]:
        """(time, name) of the recalls that a text echoes; they wait no more."""
        while self.line and self.line[0][0] + self.ttl < now:
            at, name, memory = self.line.popleft()
            held = self.by_memory.get(memory)
            if held and held[0] == (at, name):
                held.popleft()
                if not held:
                    self._forget(memory)
        told = set(words.split())
        found = []
        for memory in set().union(*(self.index[w] for w in told if w in self.index)):
            if len(told & memory) >= self.share * len(memory) - 1e-9:
                found += self.by_memory[memory]
                self._forget(memory)
        return found


class OutcomeTracker(StatefulProcessor):
    """Pending recalls of one agent and shard, until a text echoes one or its time is over.

    ``pending`` maps a slice of time, as long as a recall waits, to the recalls of that slice; a timer per slice fires when
    its next recall ends.  Nothing but an echo or its timer removes a recall.
    """

    def __init__(self, ttl: float, share: float, least: int) -> None:
        self.ttl, self.share, self.least = int(ttl * 1000), share, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slice bigint", "recalls string")

    def _store(self, part: int, recalls: dict[str, tuple[int, list[str]]]) -> None:
        """Keep the recalls of a slice and wake up when the first of them ends."""
        if not recalls:
            self.pending.removeKey((part,))
            return
        self.pending.updateValue((part,), (json.dumps([[n, at, m] for n, (at, m) in recalls.items()]),))
        self.handle.registerTimer(min(at for at, _ in recalls.values()) + self.ttl)

    @staticmethod
    def _recalls(value: Any) -> dict[str, tuple[int, list[str]]]:
        return {n: (at, m) for n, at, m in json.loads(value[0])}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        times = frame["at"].to_numpy()
        first, last = int(times.min()), int(times.max())
        slices: dict[int, dict[str, tuple[int, list[str]]]] = defaultdict(dict)
        held: dict[str, int] = {}
        events: list[tuple[int, bool, str, Any]] = []
        for (part,), value in self.pending.iterator():
            known = self._recalls(value)
            held |= {n: at for n, (at, _) in known.items()}
            # recalls that no text of this batch can reach stay as they are
            if first - 2 * self.ttl <= part * self.ttl <= last:
                slices[part] = known
                events += [(at, False, n, m) for n, (at, m) in known.items()]
        old = set(held)
        for at, is_text, name, memories, words in zip(times.tolist(), frame["event_id"].isna(), frame["event_id"], frame["memories"], frame["words"]):
            events.append((at, True, "", words) if is_text else (at, False, name, memories))
        events.sort(key=lambda e: e[:3])
        waiting, changed, used = Waiting(self.ttl, self.share), set(), []
        for now, is_text, name, what in events:
            if is_text:
                for at, echoed in waiting.echoed(now, what):
                    if held.get(echoed) == at:
                        used.append(echoed)
                        del held[echoed]
                        changed.add(at // self.ttl)
                        del slices[at // self.ttl][echoed]
                continue
            if name in old:
                if held.get(name) != now or name not in slices[now // self.ttl]:
                    continue
                old.discard(name)
                memories = slices[now // self.ttl][name][1]
            else:
                memories = [m for m in what if m.count(" ") + bool(m) >= self.least]
                if not memories or name in held:
                    continue
                held[name] = now
                changed.add(now // self.ttl)
                slices[now // self.ttl][name] = (now, memories)
            for m in memories:
                waiting.add(now, name, frozenset(m.split()))
        for part in changed:
            self._store(part, slices[part])
        yield _outcomes(used, True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = (expiredTimerInfo.getExpiryTimeInMs() - self.ttl) // self.ttl
        value = self.pending.getValue((part,))
        recalls = self._recalls(value) if value else {}
        # a timer goes off once the watermark is past it
        over = [n for n, (at, _) in recalls.items() if at + self.ttl < timerValues.getCurrentWatermarkInMs()]
        if over:
            self._store(part, {n: r for n, r in recalls.items() if n not in set(over)})
        yield _outcomes(over, False)

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def track_outcomes(stream: DataFrame, ttl: float = 1800.0, share: float = 0.6, least: int = 4) -> DataFrame:
    """(event_id, was_used) as recalls are echoed or run out of time, however many wait.

    ``stream`` comes from :func:`outcome_events` with a watermark on ``ts``.  Within a micro-batch rows are taken in the
    order of their time; a text that comes in an earlier micro-batch than its recall is not seen.  The state store must be the one of
    ``keyed_state``.
    """
    return stream.groupBy("agent", "shard").transformWithStateInPandas(
        OutcomeTracker(ttl, share, least), "event_id string, was_used boolean", "append", "eventtime"
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that map state and timers need."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


# ---- windows ---------------------------------------------------------------------------------------------------


def windowed_counts(stream: DataFrame, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window; rows later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n", "total")


def session_counts(stream: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per session of rows that follow each other within ``gap``."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n"
    )


# ---- periodic upkeep ---------------------------------------------------------------------------------------------


def heartbeat(steps: dict[str, Callable[[], Any]], has_files: bool = True) -> dict[str, Any]:
    """Run the upkeep steps in order; an error is reported under its step and does not stop the rest."""
    if not has_files:
        return {"status": "no_files"}
    report: dict[str, Any] = {"status": "ok"}
    for name, step in steps.items():
        try:
            report[name] = step()
        except Exception as exc:  # noqa: BLE001
            report[name] = {"error": f"{type(exc).__name__}: {exc}"}
    return report


def refresh(fingerprint: str, stored: str | None, rebuild: Callable[[], Any], force: bool = False) -> dict[str, Any]:
    """Rebuild only when the corpus fingerprint has changed."""
    if stored == fingerprint and not force:
        return {"refreshed": False, "fingerprint": fingerprint}
    return {"refreshed": True, "fingerprint": fingerprint, "result": rebuild()}


