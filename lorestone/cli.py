"""Command line over the library functions: search, recall, graph, notes, status."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import consolidate as C
from .operators import index as I
from .operators import notes as N
from .operators import recall as R
from .operators import search as S
from .sources import files


def _documents(spark: SparkSession, root: str) -> DataFrame:
    tree = files.text_tree(spark, {"notes": root})
    return tree.select(
        F.xxhash64("path").bitwiseAND(F.lit((1 << 40) - 1)).alias("doc_id"), "name", "source", "path", "text",
        F.lit("note").alias("doc_type"),
    )


def _query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, query string")


def search(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Ranked paragraphs with answers."""
    paragraphs = I.build_paragraphs(_documents(spark, args.notes))
    keep = S.structured_filter(args.project, args.after, args.before, args.type)
    return S.search(paragraphs, _query(spark, args.query), F.current_date(), args.top, candidates=keep).select(
        "rank", "name", "score", "confidence", "answer", "snippet"
    )


def recall(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Consolidated memories for a query."""
    memories = _documents(spark, args.notes).select(F.col("doc_id").alias("item_id"), "text")
    return R.semantic_search(memories, _query(spark, args.query), args.top).select("rank", "score", "project", "key_point")


def _traces(spark: SparkSession, root: str) -> DataFrame:
    return C.analyze_traces(_documents(spark, root).select("name", "text"))


def graph(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Strongest relations, of one entity when given."""
    relations = C.relation_table(C.trace_relations(_traces(spark, args.notes)))
    return R.graph_edges(relations, args.entity, args.top)


def entities(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Known entities by the number of traces."""
    return C.entity_table(_traces(spark, args.notes)).orderBy(F.desc("trace_count"), "id").limit(args.top)


def consolidate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Clusters of traces by project and date."""
    return C.cluster_summary(C.cluster_traces(_traces(spark, args.notes)))


def notes(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Notes from the note-worthy paragraphs of the files."""
    docs = _documents(spark, args.notes).select("name", F.explode(T.watched_paragraphs(F.col("text"))).alias("content"))
    made = N.make_notes(docs.select(F.xxhash64("name", "content").alias("seq"), "content", F.col("name").alias("source")))
    return made.select("id", "title", F.array_join("entities", ", ").alias("entities")).limit(args.top)


def status(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Files and newest change."""
    return files.store_manifest({"notes": files.file_times(spark, args.notes, "*.md")})


COMMANDS = {f.__name__: f for f in (search, recall, graph, entities, consolidate, notes, status)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorestone", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--notes", required=True, help="folder of Markdown files")
    p.add_argument("--query", default="")
    p.add_argument("--entity", default="")
    p.add_argument("--project", default="")
    p.add_argument("--after", default="")
    p.add_argument("--before", default="")
    p.add_argument("--type", default="")
    p.add_argument("--top", type=int, default=5)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("lorestone").getOrCreate()
    COMMANDS[args.command](session, args).show(args.top, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
