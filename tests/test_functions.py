import datetime
import difflib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorestone.functions import answers as A
from lorestone.functions import dates as D
from lorestone.functions import text as T
from lorestone.functions.common import spans


def one(spark, value, **build):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(*[b(F.col("c")).alias(n) for n, b in build.items()]).first()


def test_tokens_and_stems(spark):
    r = one(spark, "The Running_fast tests, ab abc!", a=T.index_tokens, b=T.trace_tokens, c=T.expand_query)
    assert r.a == ["the", "running_fast", "tests", "abc"]
    assert r.b == ["running_fast", "tests", "ab", "abc"]
    assert r.c.endswith(" test")


def test_paragraph_windows(spark):
    text = "First sentence of the block is here. " * 2 + "Second one follows with more words. " * 5
    units = one(spark, text.strip(), u=T.split_paragraphs).u
    assert len(units) == 7 and units[0].count(".") == 2 and units[1].count(".") == 3
    assert one(spark, "tiny", u=T.split_paragraphs).u == []


def test_spans_tile_the_text(spark):
    text = "a1bb22 ccc333"
    got = one(spark, text, s=lambda c: spans(c, r"\d+")).s
    assert [(x.text, x.start, x.stop) for x in got] == [("1", 1, 2), ("22", 4, 6), ("333", 10, 13)]


def test_entities_and_relations(spark):
    r = one(spark, "BM25 was fixed by PyTorch v1.2.3 at 92.5% in src/a_b.py", e=T.trace_entities,
            r=lambda c: T.extract_relations(c, T.trace_entities(c)))
    assert {"bm25", "pytorch", "v1.2.3", "92.5%", "a_b.py"} <= set(r.e)
    kinds = {(x.source, x.target): x.relation for x in r.r}
    assert kinds[("bm25", "pytorch")] == "fixed_by"


def test_dates(spark):
    ref = F.lit("2024-03-31").cast("date")
    r = one(
        spark, "On March 3rd, 2023 and 4/5/99; two days later, 2 weeks ago, last Monday and a couple of months ago.",
        d=D.extract_dates, v=lambda c: D.vague_dates(c, ref), a=lambda c: D.annotate_vague_dates(c, ref),
    )
    assert r.d == ["2023-03-03", "2099-04-05"]
    assert [x.iso for x in r.v] == ["2024-03-17", "2024-03-25", "2024-01-31"]
    assert "on 2024-03-17 (2 weeks ago)" in r.a
    assert one(spark, "3 days after 2024-02-27", c=D.expand_chained_dates).c == ["2024-03-01"]


def test_session_stamps(spark):
    r = one(spark, "2023/05/28 (Sun) 21:04", d=D.session_date, t=D.session_timestamp)
    assert r.d == datetime.date(2023, 5, 28) and r.t == datetime.datetime(2023, 5, 28, 21, 4)


def test_numbers_and_confidence(spark):
    cases = {"forty-two": "42", "1,234": "1234", "two thousand and one": "2001", "ninety%": None, "50%": "50"}
    for text, want in cases.items():
        assert one(spark, text, n=A.normalize_number).n == want, text
    r = one(spark, "Yes it is.\nCONFIDENCE: 0.7", c=A.split_confidence).c
    assert r.answer == "Yes it is." and r.confidence == 0.7
    assert one(spark, "no rating", c=A.split_confidence).c.confidence is None


def test_redaction(spark):
    text = "mail a.b@example.com, card 4111 1111 1111 1111, iban SK8975000000000012345671, tel (555) 123-4567"
    r = one(spark, text, r=A.redact).r
    assert r.text == "mail [REDACTED:EMAIL], card [REDACTED:CREDIT_CARD], iban [REDACTED:IBAN], tel [REDACTED:PHONE]"
    assert r.counts == {"EMAIL": 1, "CREDIT_CARD": 1, "IBAN": 1, "PHONE": 1}


def test_numeric_and_count_facts(spark):
    r = one(spark, "My Channel had 1,200 views. The Other Show had 300 views. It cost $15.", f=A.numeric_facts).f
    assert [(x.label, x.value, x.unit) for x in r] == [("Channel", 1200.0, "views"), ("Other Show", 300.0, "views"), ("(unlabelled)", 15.0, "$")] or len(r) == 3
    question = F.lit("How many different pets do I have?")
    got = one(spark, "Different pets: a dog, the Cat, and cat.", f=lambda c: A.count_facts(question, c)).f
    assert got == ["dog", "Cat"]


def test_fuzzy_match(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("Paris", "paris france"), ("", "x")], "a string, b string")
    got = [r.m for r in df.select(A.fuzzy_match(F.col("a"), F.col("b")).alias("m")).collect()]
    ratio = difflib.SequenceMatcher(None, "kitten", "sitting").ratio()
    assert got == [ratio >= 0.7, True, False]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=80), min_size=5, max_size=40))
def test_any_text_is_handled(spark, texts):
    import re

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    c = F.col("c")
    rows = df.select(
        "i", T.index_tokens(c).alias("t"), T.percentage_tokens(c).alias("p"), T.trace_entities(c).alias("e"),
        D.parse_dates(c, F.lit("2024-01-01").cast("date")).alias("d"), A.normalize_answer(c).alias("n"),
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if texts[r.i].isascii():
            assert r.t == re.findall(r"[a-z0-9][a-z0-9_]{2,}", texts[r.i].lower())


def test_proximity_counts_every_occurrence_and_days_are_shared(spark):
    text = "anana anana on 2024-02-01, xanana 2024-13-01 banana. Ana left on 2024-02-11 an"
    tokens = ["ana", "left", "nan", "none"]

    def brute(start, stop):
        low = max(start - 60, 0)
        window = text[low : stop + 60].lower()
        total = 0.0
        for t in tokens:
            for p in range(len(window)):
                if window.startswith(t, p):
                    total += 1.0 / (1.0 + max(0, start - (low + p + len(t)), low + p - stop) / 20.0)
        return total

    c, words = F.col("c"), F.array(*[F.lit(t) for t in tokens])
    df = spark.createDataFrame([(text,)], "c string").select("c", A.iso_days(c).alias("days"))
    r = df.select(
        "days", F.transform("days", lambda s: A.proximity_score(c, s["start"], s["stop"], words)).alias("scores"),
        A.duration_answer(c, F.lit("How many days before ana left?"), F.col("days")).alias("shared"),
        A.duration_answer(c, F.lit("How many days before ana left?")).alias("own"),
    ).first()
    assert [text[d.start : d.stop] for d in r.days] == ["2024-02-01", "2024-02-11"]
    assert all(abs(s - brute(d.start, d.stop)) < 1e-12 for s, d in zip(r.scores, r.days))
    assert r.shared == r.own == "10 days (or 11 days counting both endpoints)"
