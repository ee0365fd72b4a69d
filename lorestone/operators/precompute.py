"""Totals and distinct counts prepared for aggregate questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..plans.scale import best_per_key


def dominant_sum(facts: DataFrame, key: str) -> DataFrame:
    """(key, unit, total, n): total of the most frequent unit, the earlier one on a tie.

    ``facts`` has key, pos, unit and value; a total needs two facts of its unit.
    """
    per = facts.groupBy(key, "unit").agg(
        F.sum("value").alias("total"), F.count("*").alias("n"), F.min("pos").alias("first")
    )
    return best_per_key(per, [key], [F.desc("n"), F.asc("first"), F.asc("unit")]).where("n >= 2").select(key, "unit", "total", "n")


def precompute(pairs: DataFrame) -> DataFrame:
    """(query_id, kind, value) for (query_id, question, text, qtype) rows whose text settles them.

    Sum questions take the dominant unit, distinct-count questions the listed items.  Temporal
    questions are left to date arithmetic.
    """
    open_ = pairs.where("qtype <> 'temporal-reasoning'")
    q, t = F.col("question"), F.col("text")
    facts = open_.where(A.is_sum_question(q)).select(
        "query_id", F.posexplode(A.numeric_facts(t)).alias("pos", "f")
    ).select("query_id", "pos", F.col("f.unit").alias("unit"), F.col("f.value").alias("value"))
    totals = dominant_sum(facts, "query_id").select("query_id", F.lit("total").alias("kind"), F.col("total").alias("value"))
    counts = open_.where(A.is_count_question(q)).select("query_id", F.size(A.count_facts(q, t)).alias("n")).where("n >= 2").select(
        "query_id", F.lit("count").alias("kind"), F.col("n").cast("double").alias("value")
    )
    return totals.unionByName(counts)
