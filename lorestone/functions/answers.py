"""Answer extraction and comparison as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .common import (
    extract_all,
    first_match,
    let,
    overlap,
    rule_chain,
    spans,
    str_array,
    strip,
    token_hits,
    window_text,
    words3,
)
from .matching import block_ratio, block_ratio_reaches

ISO = r"\d{4}-\d{2}-\d{2}"
MONTH_DAY = r"(?:" + fixed.MONTH_NAMES + r")\s+\d{1,2}(?:,?\s*\d{4})?"
WHOLE_NUMBER = r"(?U)\b\d[\d,]*(?:\.\d+)?\b"
FULL_NAME = r"(?U)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"


def question_type(query: Column) -> Column:
    low = F.lower(query)
    return rule_chain([(n, low.rlike("(?U)" + p)) for n, p in fixed.QUESTION_TYPES], "generic")


def _nearest(candidates: Column, text: Column, query: Column, reach: int = 80) -> Column:
    """First candidate with the most query words around it; NULL without candidates."""


    def scored(tokens):
        return F.transform(
            candidates,
            lambda s, i: F.struct(
                let(
                    F.lower(window_text(text, s["start"] - reach, s["stop"] + reach)),
                    lambda near: token_hits(tokens, near),
                ).alias("n"),
                (-i).alias("first"),
                s["text"].alias("text"),
            ),
        )

    return F.array_max(let(words3(query), scored))["text"]


def date_answer(text: Column, query: Column | None = None) -> Column:
    found = F.concat(spans(text, ISO), spans(text, MONTH_DAY))
    return F.get(found, F.lit(0))["text"] if query is None else _nearest(found, text, query)


def number_answer(text: Column, query: Column | None = None) -> Column:
    found = F.filter(spans(text, WHOLE_NUMBER), lambda s: ~s["text"].rlike(r"^20\d{2}$"))
    return F.get(found, F.lit(0))["text"] if query is None else _nearest(found, text, query)


def version_answer(text: Column) -> Column:
    return first_match(text, r"v\d+\.\d+(?:\.\d+)?")


def percentage_answer(text: Column) -> Column:
    return first_match(text, r"(?U)\d+\.?\d*%")


def name_answer(text: Column, query: Column) -> Column:
    single = let(
        words3(query),
        lambda tokens: F.filter(
            spans(text, r"(?U)\b[A-Z][a-z]{2,}\b"),
            lambda s: let(
                F.lower(window_text(text, s["start"] - 50, s["start"] + 50)),
                lambda near: token_hits(tokens, near) > 0,
            ),
        ),
    )
    full = spans(text, FULL_NAME)
    return _nearest(let(full, lambda f: F.when(F.size(f) > 0, f).otherwise(single)), text, query)


def yes_no_answer(text: Column, query: Column) -> Column:
    """No when more query words stand near a negation than do not."""
    marks = str_array(fixed.NEGATION_MARKERS)
    words = F.array_distinct(extract_all(F.lower(query), r"(?U)\w{3,}"))

    def votes(low):
        return F.transform(
            F.filter(words, lambda t: low.contains(t)),
            lambda t: let(
                window_text(low, F.instr(low, t) - 41, F.instr(low, t) + 39),
                lambda near: F.when(F.exists(marks, lambda m: near.contains(m)), 1).otherwise(-1),
            ),
        )

    total = F.aggregate(let(F.lower(text), votes), F.lit(0), lambda a, v: a + v)
    return F.when(total > 0, "No").otherwise("Yes")


def proximity_score(text: Column, start: Column, stop: Column, tokens: Column) -> Column:
    """Distance-weighted count of token occurrences within 60 characters."""
    low = F.greatest(start - 60, F.lit(0))

    def total(window):
        def token_score(acc, t):
            # cut before each occurrence, overlapping ones too; a cut at the very start leaves no empty piece
            pieces = F.split(window, F.concat(F.lit("(?="), t, F.lit(")")), -1)

            def add(so_far, piece):
                begin = low + so_far["at"]
                gap = F.greatest(F.lit(0), start - (begin + F.length(t)), begin - stop)
                hit = (so_far["at"] > 0) | window.startswith(t)
                return F.struct(
                    (so_far["at"] + F.length(piece)).alias("at"),
                    (so_far["sum"] + F.when(hit, 1.0 / (1.0 + gap / 20.0)).otherwise(0.0)).alias("sum"),
                )

            none = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
            return acc + F.when(window.contains(t), F.aggregate(pieces, none, add, lambda x: x["sum"])).otherwise(0.0)

        return F.aggregate(tokens, F.lit(0.0), token_score)

    return let(F.lower(window_text(text, low, stop + 60)), total)


def iso_days(text: Column) -> Column:
    """Valid ISO dates in a text with their bounds: array<struct<i,start,stop,day>>."""
    dated = F.transform(
        spans(text, r"(?U)\b\d{4}-\d{2}-\d{2}\b"),
        lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["stop"].alias("stop"), F.try_to_date(s["text"], "yyyy-MM-dd").alias("day")),
    )
    return F.filter(dated, lambda x: x["day"].isNotNull())


def duration_answer(text: Column, query: Column, days: Column | None = None) -> Column:
    """Time between the two dates closest to the query words; NULL below two dates.

    ``days`` are the :func:`iso_days` of the text, for several questions on one text.
    """

    def ranked(tokens):
        return F.transform(
            iso_days(text) if days is None else days,
            lambda s: F.struct(
                (-proximity_score(text, s["start"], s["stop"], tokens)).alias("rank"), s["i"].alias("i"), s["day"].alias("day")
            ),
        )

    def pair(best):
        one, two = F.get(best, F.lit(0)), F.get(best, F.lit(1))
        near = (one["rank"] < 0) & (two["rank"] < 0) & (one["day"] != two["day"])
        days = F.transform(best, lambda x: x["day"])
        return F.struct(
            F.when(near, F.least(one["day"], two["day"])).otherwise(F.array_min(days)).alias("first"),
            F.when(near, F.greatest(one["day"], two["day"])).otherwise(F.array_max(days)).alias("last"),
            F.size(best).alias("n"),
        )

    ends = let(F.array_sort(let(words3(query), ranked)), pair)
    return let(
        ends, lambda e: F.when(e["n"] >= 2, duration_text(e["first"], e["last"], query))
    )


def months_apart(first: Column, last: Column) -> Column:
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)


def duration_text(first: Column, last: Column, query: Column) -> Column:
    q = F.lower(query)
    d = F.datediff(last, first)
    tail = F.format_string(" (%d days exclusive, %d inclusive)", d, d + 1)
    return (
        F.when(q.contains("week"), F.concat(F.format_string("%d weeks", F.floor(d / 7)), tail))
        .when(q.contains("month"), F.concat(F.format_string("%d months", months_apart(first, last)), tail))
        .otherwise(F.format_string("%d days (or %d days counting both endpoints)", d, d + 1))
    )


def extract_answer(query: Column, text: Column) -> Column:
    """Short answer by question type; a typed miss gives NULL."""
    kind = question_type(query)
    return (
        F.when(kind == "when", date_answer(text, query))
        .when(
            F.lower(query).rlike("(?U)" + dict(fixed.QUESTION_TYPES)["duration"]),
            F.coalesce(duration_answer(text, query), number_answer(text, query)),
        )
        .when(kind == "how_many", number_answer(text, query))
        .when(kind == "version", version_answer(text))
        .when(kind == "who", name_answer(text, query))
        .when(kind == "yes_no", yes_no_answer(text, query))
        .when(kind == "percent", percentage_answer(text))
        .otherwise(
            F.coalesce(
                percentage_answer(text), version_answer(text), date_answer(text), number_answer(text)
            )
        )
    )


def answer_candidates(query: Column, text: Column) -> Column:
    """array<struct<answer,type,score>>, best score first, in reading order on ties."""
    tokens = words3(query)
    kinds = [
        (ISO, "date", 0.8),
        (r"(?U)\d+\.?\d*%", "percentage", 0.7),
        (r"v\d+\.\d+(?:\.\d+)?", "version", 0.7),
        (r"(?U)\b\d[\d,]+(?:\.\d+)?\b", "number", 0.5),
        (FULL_NAME, "name", 0.4),
    ]

    def labelled(kind: str, base: float):
        return lambda m: F.struct(
            m.alias("answer"), F.lit(kind).alias("type"), F.lit(base).alias("base")
        )

    found = F.concat(*[F.transform(extract_all(text, p), labelled(k, b)) for p, k, b in kinds])

    def scored(x, i):
        at = F.instr(text, x["answer"]) - 1
        near = token_hits(tokens, F.lower(window_text(text, at - 80, at + F.length(x["answer"]) + 80)))
        return F.struct(
            (-(x["base"] + near * 0.1)).alias("rank"), i.alias("i"),
            x["answer"].alias("answer"), x["type"].alias("type"),
        )

    return F.transform(
        F.array_sort(F.transform(found, scored)),
        lambda x: F.struct(x["answer"].alias("answer"), x["type"].alias("type"), (-x["rank"]).alias("score")),
    )


def best_sentence(query: Column, text: Column) -> Column:
    """First sentence sharing the most words with the query; NULL when none does."""
    scored = let(
        words3(query),
        lambda tokens: F.transform(
            F.split(text, r"(?U)(?<=[.!?])\s+", -1),
            lambda s, i: F.struct(overlap(tokens, words3(s)).alias("n"), (-i).alias("i"), s.alias("s")),
        ),
    )
    return let(F.array_max(scored), lambda top: F.when(top["n"] > 0, top["s"]))


# ---- comparing answers ------------------------------------------------------------------


def normalize_answer(c: Column) -> Column:
    """Answer core: polarity word for yes/no, else the text before its explanation."""
    text = strip(F.regexp_replace(strip(c), fixed.ANSWER_HEDGE, ""))
    polar = F.coalesce(first_match(text, fixed.ANSWER_YES), first_match(text, fixed.ANSWER_NO))
    core = strip(F.get(F.split(text, fixed.ANSWER_EXPLANATION, 2), F.lit(0)))
    core = F.when(core.endswith("."), strip(F.substring(core, F.lit(1), F.length(core) - 1))).otherwise(core)
    return F.coalesce(F.lower(strip(polar)), F.lower(core))


def answer_items(c: Column) -> Column:
    parts = F.split(
        normalize_answer(c), r"(?U)\s*,\s+(?:and\s+)?|\s*,\s*|\s+and\s+|\s+or\s+", -1
    )
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(strip(x))), lambda x: x != ""))


def answers_match(predicted: Column, truth: Column, threshold: float = 0.25) -> Column:
    p, g = normalize_answer(predicted), normalize_answer(truth)
    yes = lambda x: x.rlike(fixed.ANSWER_YES)
    no = lambda x: x.rlike(fixed.ANSWER_NO)
    wanted = answer_items(truth)
    shared = overlap(answer_items(predicted), wanted)
    return (
        F.when((p == "") | (g == ""), F.lit(False))
        .when((p == g) | g.contains(p) | p.contains(g), F.lit(True))
        .when((yes(p) & yes(g)) | (no(p) & no(g)), F.lit(True))
        .when((yes(p) & no(g)) | (no(p) & yes(g)), F.lit(False))
        .otherwise((shared > 0) & (shared / F.greatest(F.size(wanted), F.lit(1)) >= threshold))
    )


def fuzzy_match(candidate: Column, gold: Column, threshold: float = 0.7) -> Column:
    """Whether an answer holds the other, or their matching blocks reach the threshold; pairs that are decided are not compared."""
    c, g = strip(F.lower(candidate)), strip(F.lower(gold))
    some = (candidate != "") & (gold != "")
    close = c.contains(g) | g.contains(c)
    open_ = some & ~close
    alike = block_ratio_reaches(F.when(open_, c), F.when(open_, g), threshold)
    return F.when(~some, F.lit(False)).when(close, F.lit(True)).otherwise(alike)


def lexical_similarity(a: Column, b: Column) -> Column:
    x, y = normalize_answer(a), normalize_answer(b)
    some = (x != "") & (y != "")
    return F.when(~some, F.lit(0.0)).otherwise(block_ratio(F.when(some, x), F.when(some, y)))


def normalize_number(c: Column) -> Column:
    """Digits without commas, or number words; NULL when neither."""
    t = F.lower(strip(c))
    digits = first_match(t, r"^([\d,]+\.?\d*)%?$", 1)
    values = F.create_map(*[F.lit(x) for kv in fixed.NUMBER_WORDS.items() for x in kv])

    def step(acc, word):
        value = F.element_at(values, word)
        known = value.isNotNull()
        stop = acc["stop"] | (~known & (word != "and"))
        big = F.greatest(acc["total"], F.lit(1)) * value
        total = F.when(acc["stop"] | ~known, acc["total"]).otherwise(
            F.when(value >= 100, big).otherwise(acc["total"] + value)
        )
        return F.struct(
            total.alias("total"), stop.alias("stop"), (acc["any"] | (known & ~acc["stop"])).alias("any")
        )

    words = F.aggregate(
        F.split(t, r"(?U)[-\s]+", -1),
        F.struct(F.lit(0).alias("total"), F.lit(False).alias("stop"), F.lit(False).alias("any")),
        step,
    )
    return F.coalesce(
        F.regexp_replace(digits, ",", ""), F.when(words["any"], words["total"].cast("string"))
    )


def split_confidence(c: Column) -> Column:
    """struct<answer, confidence>: a trailing rating line is cut off and clamped to [0, 1]."""
    rating = first_match(c, fixed.CONFIDENCE_LINE, 1).try_cast("double")
    clamped = F.when(rating.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), rating)))
    cleaned = strip(F.regexp_replace(c, fixed.CONFIDENCE_LINE, ""))
    return F.struct(cleaned.alias("answer"), clamped.alias("confidence"))


def logistic(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), score))))


# ---- signals, decisions, personal data ------------------------------------------------------


def detect_signals(c: Column) -> Column:
    """array<struct<signal,confidence,context>>, most confident first."""
    low = F.lower(c)
    rules = [("correction", p, w) for p, w in fixed.CORRECTION_SIGNALS]
    rules += [("reinforcement", p, w) for p, w in fixed.REINFORCEMENT_SIGNALS]
    found = []
    for i, (kind, pattern, weight) in enumerate(rules):
        p = "(?U)" + pattern
        start = F.regexp_instr(low, F.lit(p)) - 1
        stop = start + F.length(F.regexp_extract(low, p, 0))
        found.append(
            F.when(
                low.rlike(p),
                F.struct(
                    F.lit(-weight).alias("rank"), F.lit(i).alias("i"), F.lit(kind).alias("signal"),
                    window_text(c, start - 40, stop + 40).alias("context"),
                ),
            )
        )
    return F.transform(
        F.array_sort(F.array_compact(F.array(*found))),
        lambda x: F.struct(x["signal"].alias("signal"), (-x["rank"]).alias("confidence"), x["context"].alias("context")),
    )


def message_class(c: Column) -> Column:
    """Class of the most confident signal without building the contexts."""
    low = F.lower(c)
    rules = [(w, 0, "correction", p) for p, w in fixed.CORRECTION_SIGNALS]
    rules += [(w, 1, "reinforcement", p) for p, w in fixed.REINFORCEMENT_SIGNALS]
    rules.sort(key=lambda r: (-r[0], r[1]))
    return rule_chain([(kind, low.rlike("(?U)" + p)) for _, _, kind, p in rules], "neutral")


def decision_points(c: Column) -> Column:
    """Sentences that weigh or announce a decision."""
    any_rule = "(?iU)" + "|".join(fixed.DECISION_POINTS)
    return F.filter(
        F.transform(F.split(c, r"[.!?\n]", -1), strip),
        lambda s: (F.length(s) >= 15) & s.rlike(any_rule),
    )


def redact(c: Column, extra: list[tuple[str, str]] | None = None, skip: tuple[str, ...] = ()) -> Column:
    """struct<text, counts> with personal data and secrets replaced by their tag."""
    text, counts = c, []
    for tag, pattern in [*fixed.REDACTIONS, *(extra or [])]:
        if tag in skip:
            continue
        counts += [F.lit(tag), F.regexp_count(text, F.lit(pattern))]
        text = F.regexp_replace(text, pattern, f"[REDACTED:{tag}]")
    found = F.map_filter(F.create_map(*counts), lambda _k, v: v > 0)
    return F.struct(text.alias("text"), found.alias("counts"))


def redact_text(c: Column) -> Column:
    """Only the redacted text; one replacement per rule."""
    for tag, pattern in fixed.REDACTIONS:
        c = F.regexp_replace(c, pattern, f"[REDACTED:{tag}]")
    return c


# ---- numeric and countable facts ---------------------------------------------------------------


def numeric_facts(c: Column) -> Column:
    """array<struct<label,value,unit,raw>>: labelled ``number unit`` pairs, then money."""
    number = lambda s: F.translate(s, ",", "").try_cast("double")
    counted = F.transform(
        spans(c, rf"(?U){fixed.NUMBER}\s+(?:{fixed.NUMBER_UNITS})\b"),
        lambda s: F.struct(
            F.try_element_at(
                extract_all(window_text(c, s["start"] - 80, s["start"]), "(?U)" + fixed.NUMBER_LABEL),
                F.lit(-1),
            ).alias("label"),
            number(F.regexp_extract(s["text"], fixed.NUMBER, 0)).alias("value"),
            F.lower(F.regexp_extract(s["text"], r"(?U)\s+(\w+)$", 1)).alias("unit"),
            s["text"].alias("raw"),
        ),
    )
    money = (
        r"(?iU)(?:([A-Z][A-Za-z0-9.+\-]+)[:\s]+(?:spent|cost|paid|charged|was|is)?\s*)?"
        rf"(?:([$£€¥])\s*({fixed.NUMBER}))|(?:(CHF|USD|EUR|GBP)\s+({fixed.NUMBER}))"
    )
    part = lambda s, g: F.nullif(F.regexp_extract(s, money, g), F.lit(""))
    priced = F.transform(
        extract_all(c, money),
        lambda s: F.struct(
            F.coalesce(part(s, 1), F.lit("(unlabelled)")).alias("label"),
            number(F.coalesce(part(s, 3), part(s, 5))).alias("value"),
            F.upper(F.coalesce(part(s, 2), part(s, 4))).alias("unit"),
            s.alias("raw"),
        ),
    )
    usable = lambda x: x["label"].isNotNull() & x["value"].isNotNull()
    return F.filter(F.concat(counted, priced), usable)


def is_sum_question(c: Column) -> Column:
    return c.rlike(fixed.SUM_QUESTION)


def is_count_question(c: Column) -> Column:
    return ~is_sum_question(c) & c.rlike(fixed.COUNT_QUESTION)


def count_target(question: Column) -> Column:
    """What an explicit distinct-count question counts, NULL for other questions."""
    pattern = (
        r"(?i)\bhow many\s+(?:different|unique|distinct)\s+([a-z][a-z0-9 \-]*?)"
        r"(?:\s+(?:did|do|have|has|had|am|are|was|were|that|which|in|from|for|to|of)\b|\?)"
    )
    return F.nullif(
        strip(F.regexp_replace(F.lower(first_match(question, pattern, 1)), r"\s+", " ")), F.lit("")
    )


def _target_terms(c: Column) -> Column:
    words = F.filter(
        extract_all(F.lower(c), r"[a-z0-9]+"),
        lambda t: (F.length(t) > 2) & ~t.isin("different", "distinct", "unique", "type", "types", "of"),
    )
    cut = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    return F.transform(
        words,
        lambda t: F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(cut(t, 3), F.lit("y")))
        .when(t.endswith("s") & (F.length(t) > 3), cut(t, 1))
        .otherwise(t),
    )


def _distinct_labels(items: Column) -> Column:
    clean = F.transform(
        items,
        lambda x: strip(
            F.regexp_replace(
                F.regexp_replace(F.regexp_replace(x, r"^[ \t\n\r.:\-]+|[ \t\n\r.:\-]+$", ""),
                                 r"(?i)^(?:a|an|the)\s+", ""),
                r"\s+", " ",
            )
        ),
    )
    kept = F.filter(clean, lambda x: (F.length(x) >= 2) & ~x.rlike(r"^\d+(?:\.\d+)?$"))
    first_of = F.filter(
        F.transform(kept, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: F.array_position(F.transform(kept, F.lower), F.lower(s["x"])) == s["i"] + 1,
    )
    return F.transform(first_of, lambda s: s["x"])


def count_facts(question: Column, text: Column) -> Column:
    """Distinct items an explicit distinct-count question asks for, first spelling kept."""
    target = count_target(question)
    listed = r"(?i)\b(?:different|unique|distinct)\s+([A-Za-z0-9 \-]+):\s*([^.\n]+)"
    lists = F.filter(
        F.arrays_zip(extract_all(text, listed, 1).alias("category"), extract_all(text, listed, 2).alias("items")),
        lambda x: (F.size(_target_terms(target)) == 0)
        | F.arrays_overlap(_target_terms(target), _target_terms(x["category"])),
    )
    items = F.flatten(
        F.transform(lists, lambda x: F.split(x["items"], r"(?U)\s*(?:,|;|\band\b)\s*", -1))
    )
    doctors = _distinct_labels(extract_all(text, r"(?U)\bDr\.\s+[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?\b"))
    found = F.when(target.contains("doctor") & (F.size(doctors) >= 2), doctors).otherwise(
        _distinct_labels(items)
    )
    return F.when(target.isNotNull(), found).otherwise(F.array().cast("array<string>"))
