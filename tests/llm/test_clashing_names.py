"""Columns of the input may have any names, also those that the operators use inside."""

import random

from pyspark.sql import functions as F

from lorestone.llm import crossparse, hostrules, jaccard, mixing, sanitise

INNER = ["_digest", "_spans", "_id", "_source", "_copies", "_copy", "_kept_id", "_text", "score", "lang_pred", "judged", "key", "size", "n"]


def corpus(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", rng.choice("ab"), 1) for i in range(30)]
    rows += [(100 + i, rows[0][1] + " x" * i, "en", "a", 1) for i in range(2)]
    rows.append((200, rows[5][1] + " mail me at someone@example.org now", "en", "a", 1))
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain, plain.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in INNER])


def same(plain, extra, run):
    """The operator gives the same rows with further columns, and hands those on."""
    a, b = run(plain), run(extra)
    assert set(INNER) <= set(b.columns)
    rows = b.select(*plain.columns, *INNER).collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in INNER)
    key = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert key(a) == key(b) and len(rows) == a.count()


def test_stages_with_clashing_columns(spark):
    plain, extra = corpus(spark)
    for run in (sanitise.sanitised, mixing.mixed_rows, jaccard.first_of_groups, hostrules.judge):
        same(plain, extra, run)
    assert {r.text.endswith("me at [EMAIL] now") for r in sanitise.sanitised(extra).where("doc_id = 200").collect()} == {True}


def test_language_with_clashing_columns(spark):
    plain, extra = corpus(spark)
    model = spark.sparkContext.broadcast(crossparse.learn(plain))
    same(plain, extra, lambda df: crossparse.identify(df, model, F.col("text")))
    found = crossparse.identify(extra, model, F.col("text"))
    assert {r._lang_pred for r in found.select("_lang_pred", "_score").collect()} == {"en"}
