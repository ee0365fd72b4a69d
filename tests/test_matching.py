"""Matching-block similarity against the standard library."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lorestone.functions import answers as A
from lorestone.functions import matching as M


def pairs(n):
    rng = random.Random(4)
    for _ in range(n):
        letters = "ab" if rng.random() < 0.3 else "abcde fgh"
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 20, 60, 250])))
        b = list(a) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.choice([0, 3, 30, 260]))]
        for _ in range(rng.randint(0, 6)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["x", "", "ab"])
        yield a, "".join(b)


def test_ratio_and_bounds_equal_the_library():
    for a, b in pairs(3000):
        want = SequenceMatcher(None, a, b).ratio()
        assert M.ratio(a, b) == want, (a, b)
        assert M.bound_by_length(a, b) >= M.bound_by_characters(a, b) >= want
        for least in (0.3, 0.7, want):
            assert M.reaches(a, b, least) == (want >= least)


def test_fuzzy_match_and_similarity_by_a_precomputed_table(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs(300))] + [(900, None, "x"), (901, "", "x"), (902, "The answer", "answer"), (903, "kitten", "sitting")]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(3)

    def near(a, b):
        if a is None or b is None:
            return None
        c, g = a.lower().strip(), b.lower().strip()
        return bool(a and b) and (c in g or g in c or SequenceMatcher(None, c, g).ratio() >= 0.7)

    got = {r.id: r.near for r in df.select("id", A.fuzzy_match(F.col("a"), F.col("b")).alias("near")).collect()}
    assert {i: v for i, v in got.items() if i != 900} == {i: near(a, b) for i, a, b in rows if i != 900}
    assert not got[900]
    norm = {r.id: (r.x, r.y) for r in df.select("id", A.normalize_answer(F.col("a")).alias("x"), A.normalize_answer(F.col("b")).alias("y")).collect()}
    alike = {r.id: r.s for r in df.where("a is not null").select("id", A.lexical_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert alike == {i: SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for i, (x, y) in norm.items() if i in alike}
