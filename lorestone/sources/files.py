"""Readers and writers for text trees, JSON lines, session corpora, vectors and reports."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..functions.common import strip
from ..functions.vectors import dequantize, quantize


def text_tree(spark: SparkSession, roots: dict[str, str], glob: str = "*.md", skip: tuple[str, ...] = ()) -> DataFrame:
    """(source, path, name, text, modified) of every matching file below the roots, one row per file.

    Files whose path holds one of ``skip`` are left out.
    """
    out = None
    for source, root in roots.items():
        rows = (
            spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .text(root).select(
                F.lit(source).alias("source"), F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"),
                F.col("_metadata.file_modification_time").alias("modified"),
            )
        )
        out = rows if out is None else out.unionByName(rows)
    for part in skip:
        out = out.where(~F.col("path").contains(part))
    return out


def file_times(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modified, length) of files without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def needs_rebuild(sources: DataFrame, index: DataFrame) -> DataFrame:
    """One row: whether any source file is newer than the newest index file."""
    newest = index.agg(F.max("modified")).scalar()
    return sources.agg(F.coalesce(F.max("modified") > newest, F.lit(True)).alias("stale"))


def store_manifest(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage_pos, stage, newest, count) for stages from source to sink."""
    out = None
    for pos, (name, files) in enumerate(stages.items()):
        row = files.agg(F.max("modified").alias("newest"), F.count("*").alias("count")).select(
            F.lit(pos).alias("stage_pos"), F.lit(name).alias("stage"), "newest", "count"
        )
        out = row if out is None else out.unionByName(row)
    return out


def memory_files(spark: SparkSession, root: str) -> DataFrame:
    """Markdown memories with their frontmatter fields and body."""
    f = F.col("f")
    files = text_tree(spark, {"semantic": root}).withColumn("f", T.frontmatter(F.col("text")))
    blank = lambda c: F.nullif(c, F.lit(""))
    return files.select(
        "path", "name", f["type"].alias("type"), f["date"].alias("date"), f["project"].alias("project"),
        F.coalesce(f["validity_state"], F.lit("active")).alias("validity_state"),
        F.try_to_date(F.substring(F.coalesce(blank(f["last_accessed"]), blank(f["last_validated"])), 1, 10), "yyyy-MM-dd").alias("last_accessed"),
        strip(F.regexp_replace("text", r"(?s)^---.*?---", "")).alias("body"), "text",
    )


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Well-formed JSON objects of a line file; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def notes(spark: SparkSession, path: str) -> DataFrame:
    n = _lines(spark, path, schemas.NOTE)
    return n.where("id is not null").withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).withColumn(
        "source_quality", F.coalesce("source_quality", F.lit("inferred"))
    )


def triggers(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, schemas.TRIGGER)


def entity_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations); a broken line fails the read."""
    read = lambda name, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}")
    relations = read("relations.jsonl", schemas.RELATION).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return read("entities.jsonl", schemas.ENTITY), relations


def events(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, schemas.EVENT).withColumn("paragraph_idx", F.coalesce("paragraph_idx", F.lit(0)))


def compiled_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts with all required fields; priority defaults to 1, truth mode to current."""
    f = _lines(spark, path, schemas.COMPILED_FACT)
    for c in ("fact_id", "fact_type", "subject", "fact", "source"):
        f = f.where(F.coalesce(F.col(c), F.lit("")) != "")
    return f.withColumns({
        "priority": F.coalesce("priority", F.lit(1.0)), "truth_mode": F.coalesce("truth_mode", F.lit("current")),
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")),
    })


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows in file order as ``pos``; rows without a string id are left out."""
    rows = spark.read.option("mode", "PERMISSIVE").schema(
        schemas.LEDGER + ", _corrupt string"
    ).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # within one append-only file later rows have larger ids
    return rows.withColumn("pos", F.monotonically_increasing_id()).where(
        "_corrupt is null and kind in ('query', 'outcome') and event_id is not null"
    ).drop("_corrupt")


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, schemas.HISTORY).where("query is not null").withColumn("pos", F.monotonically_increasing_id())


def append_history(results: DataFrame, path: str, timestamp: float, keep: int = 5) -> None:
    """One history line per query with its first five results; results have query, name, score, rank."""
    rows = results.where(F.col("rank") <= keep).groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("name").alias("trace"), "score"))).alias("r")
    )
    shown = F.transform("r", lambda x: F.struct(x["trace"].alias("trace"), x["score"].alias("score")))
    append_lines(rows.select("query", F.lit(timestamp).alias("timestamp"), shown.alias("results")), path)


def hypotheses(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, schemas.HYPOTHESIS).where("question_id is not null")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed rows with their physical line number, for one relay file."""
    lines = spark.read.option("wholetext", False).text(path)
    numbered = lines.withColumn("_id", F.monotonically_increasing_id())
    from ..plans.ordered import row_index

    rows = row_index(numbered, [], ["_id"], "line_no")
    return rows.select("line_no", F.from_json("value", schemas.FEED).alias("r")).select("line_no", "r.*")


def hub_events(spark: SparkSession, url: str, table: str, after: int, kinds: list[str], **options: str) -> DataFrame:
    """Events behind a sequence number from a database table; the filter runs in the database."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.where((F.col("seq") > after) & F.col("kind").isin(kinds))


def stimuli(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file of a directory."""
    rows = spark.read.schema(schemas.STIMULUS).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("content", F.coalesce("content", "text")).withColumn("actor", F.coalesce("actor", "source"))


def sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, turns) of a nested session corpus; turns are (scope, session_idx, turn_idx, ...)."""
    raw = spark.read.schema(schemas.SESSIONS).option("multiLine", True).json(path)
    questions = raw.select(
        F.col("question_id").alias("query_id"), F.col("question_id").alias("scope"), "question",
        F.col("question_type").alias("qtype"), F.col("question_date").alias("reference_date"), "answer_session_ids",
    )
    per = raw.select(
        F.col("question_id").alias("scope"), "haystack_dates", "haystack_session_ids",
        F.posexplode("haystack_sessions").alias("session_idx", "session"),
    )
    turns = per.select(
        "scope", "session_idx", F.coalesce(F.get("haystack_dates", F.col("session_idx")), F.lit("")).alias("session_date"),
        F.get("haystack_session_ids", F.col("session_idx")).alias("session_id"), F.posexplode("session").alias("turn_idx", "t"),
    )
    return questions, turns.select(
        "scope", "session_idx", "session_id", "turn_idx", F.col("t.role").alias("role"), F.col("t.content").alias("text"), "session_date"
    )


def flat_sessions(turns: DataFrame) -> DataFrame:
    """One text per session in turn order; a session is one conversation."""
    return turns.groupBy("scope", "session_idx").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn_idx", "role", "text"))),
                lambda t: F.concat(t["role"], F.lit(": "), t["text"]),
            ), "\n",
        ).alias("text")
    )


# ---- vectors and reports --------------------------------------------------------------------------


def write_vectors(vectors: DataFrame, path: str, compact: bool = True) -> None:
    """Vector table as parquet; compact stores int8 codes with one scale per row."""
    out = vectors
    if compact:
        out = vectors.withColumn("q", quantize(F.col("embedding"))).drop("embedding")
    out.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    v = spark.read.parquet(path)
    return v.withColumn("embedding", dequantize(F.col("q"))).drop("q") if "q" in v.columns else v


def http_encoder(url: str, model: str, timeout: float = 30.0, headers: dict[str, str] | None = None) -> Callable[[list[str]], np.ndarray]:
    """Embedding provider that posts batches of texts; answers are put in index order."""

    def encode(texts: list[str]) -> np.ndarray:
        body = json.dumps({"model": model, "input": texts}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
            rows = sorted(json.load(reply)["data"], key=lambda r: int(r.get("index", 0)))
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return np.array([r["embedding"] for r in rows], dtype="float64")

    return encode


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_memories(parts: DataFrame, path: str, category: Column) -> None:
    """Memory parts as a parquet table by category."""
    parts.withColumn("category", category).write.mode("overwrite").partitionBy("category").parquet(path)


def commit_log(spark: SparkSession, path: str, record: str = "\x1e", field: str = "\x1f") -> DataFrame:
    """(sha, message, author, ts, body) from a text dump of a commit log.

    Each commit begins with the ``record`` mark and has its fields behind ``field`` marks, as in
    ``git log --format=%x1e%H%x1f%s%x1f%an%x1f%at%x1f%b``.  Spark cuts the file at the record marks, so bodies may have any
    number of lines and a large dump is read by many tasks.  Records without four fields or a whole time are left out.
    """
    parts = F.split("value", field, -1)
    rows = spark.read.option("lineSep", record).text(path).select(parts.alias("f")).where(F.size("f") >= 4)
    at = F.col("f")[3].try_cast("long")
    return rows.select(
        strip(F.col("f")[0]).alias("sha"), F.col("f")[1].alias("message"), F.col("f")[2].alias("author"), at.alias("ts"),
        strip(F.coalesce(F.get("f", F.lit(4)), F.lit(""))).alias("body"),
    ).where("sha <> '' and ts is not null")


def new_commits(log: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits behind the last seen one of their project, the new last ones) of a log with a column ``project``.

    ``seen`` has (project, sha).  A log lists a project's commits by time, ties by sha; where the seen one is not in it, all count.
    """
    order = F.struct("ts", "sha")
    marks = seen.join(log.select("project", "sha", order.alias("mark")), ["project", "sha"]).select("project", "mark")
    fresh = log.join(marks, "project", "left").where(F.col("mark").isNull() | (order > F.col("mark"))).drop("mark")
    last = log.groupBy("project").agg(F.max(order)["sha"].alias("sha"))
    return fresh, last.unionByName(seen.join(last.select("project"), "project", "left_anti").select("project", "sha"))


def commit_stimuli(commits: DataFrame) -> DataFrame:
    """(text, source, project, timestamp) of commits, as the observer takes them in."""
    text = F.concat("project", F.lit(": "), "message", F.lit(" (by "), "author", F.lit(")"))
    return commits.select(text.alias("text"), F.concat(F.lit("git-"), "project").alias("source"), "project", F.col("ts").alias("timestamp"))


def corpus_chunks(spark: SparkSession, roots: dict[str, str], glob: str = "*.txt") -> DataFrame:
    """Normalised chunks of text files."""
    files = text_tree(spark, roots, glob)
    flat = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"[ \t]+", " ")
    return files.select("source", "path", F.posexplode(T.split_paragraphs(flat)).alias("para_idx", "unit")).select(
        "source", "path", "para_idx", T.chunk_text(F.col("unit")).alias("text")
    )
