"""Cheap tests before costly patterns leave the results as they are."""

import pytest
from pyspark.sql import functions as F

from lorestone.functions import fixed
from lorestone.functions import text as T
from lorestone.functions.common import extract_all, literal_starts, may_match, strip

TEXTS = [
    "She LIKEs tea. He workſ at Oslo. I LİKES nothing. V1.2 becauſe of GPU and PyTorch fıxed it, BM25.",
    "Alice was from Oslo to Lima; my favourite colour is red. FAVORITE food was pie.", "unfixed CUDAfixedGPU because", "", None,
    "Who is into chess? Married to Bob. allergic\nto nuts; travelled to Rome.", "Working as a cook, is a nurse. Job is fine!", "He enjoys CPU rowing, and worKs at a GPU plant.",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def test_literal_starts():
    assert literal_starts(r"(?:works? (?:as|at)|is a |travel(?:led)? to|o{2}ps)\s+") == ["work", "is a ", "travel", ""]
    assert literal_starts(r"v\d+|from .+ to|(?:x)y") == ["v", "from ", ""]


def test_texts_that_pass_over_a_pattern_do_not_match_it(texts):
    c = F.col("text")
    patterns = [words for words, *_ in fixed.PARAGRAPH_QUESTIONS + fixed.NOTE_QUESTIONS] + [p.replace(r"\b", "") for _, p in fixed.RELATION_PATTERNS]
    for p in patterns:
        wrong = texts.where(c.rlike("(?iUd)" + p) & ~may_match(c, F.lower(c), p))
        assert wrong.count() == 0, p
    words, body, _ = fixed.PARAGRAPH_QUESTIONS[0]
    plain = F.transform(extract_all(c, "(?iUd)" + words + body + T._END, 1), lambda x: F.lower(strip(x)))
    rows = texts.select(plain.alias("a"), T._phrases(c, words, body, F.lower(c)).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and any(r.a for r in rows)


def test_relations_between_words_cut_at_their_ends(texts):
    ents = F.array(*[F.lit(x) for x in ("BM25", "CPU", "CUDA", "GPU", "Lima", "Oslo", "PyTorch")])
    found = texts.select("id", F.inline(T.extract_relations(F.col("text"), ents, max_gap=None))).collect()
    kinds = {(r.id, r.source, r.target): r.relation for r in found}
    # the long s is no s for the first pattern of the text, yet it is for the pattern
    assert kinds[0, "GPU", "PyTorch"] == "co_occurs" and kinds[0, "BM25", "PyTorch"] == "fixed_by"
    assert kinds[1, "Lima", "Oslo"] == "co_occurs" and kinds[2, "CUDA", "GPU"] == "co_occurs"


def test_flags_are_not_worked_out_per_entity(texts):
    entities, words = F.array(F.lit("gpu"), F.lit("bm25")), F.array().cast("array<string>")
    plan = texts.select(T.note_queries(F.col("text"), F.lit(""), entities, words))._jdf.queryExecution().optimizedPlan().toString()
    # before, percentages were read again for every entity
    inner = plan[plan.index("what about") - 200 : plan.index("what is the score for") + 200]
    assert "%?" not in inner
