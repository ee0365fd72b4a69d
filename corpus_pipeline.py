"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Every stage gets all rows of the one before as a table on disk; all but the last return the columns of
``documents``.  An empty table passes through every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.llm.common import table
from lorestone.llm.hostrules import judge
from lorestone.llm.jaccard import first_of_groups
from lorestone.llm.mixing import mixed_rows
from lorestone.llm.packing import pack
from lorestone.llm.sanitise import sanitised
from lorestone.session import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of text and host keep."""
    # written first: a filter pushed below the measures would repeat them many times over
    judged = settle(judge(docs))
    return judged.where(F.col(judged.columns[-1])["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group: five-word shingles, similarity of 0.8 or more."""
    return first_of_groups(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that reveal it replaced; n_chars follows the text."""
    clean = sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data),
    ("mixing", mixing), ("packing", packing),
]

#: tokens, similarity components and entity statistics have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
