"""Dates in text: extraction, relative expressions, recency and phase."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .common import by_text, contains_any, extract_all, first_match, iso_date, plain, spans, strip, window_text

MONTH_NUMBER = {k: v for k, v in fixed.MONTHS.items()}


def _month_number(name: Column) -> Column:
    out = None
    for word, number in MONTH_NUMBER.items():
        cond = F.lower(name) == word
        out = F.when(cond, F.lit(number)) if out is None else out.when(cond, F.lit(number))
    return out


def _iso(year: Column, month: Column, day: Column) -> Column:
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(year.cast("string"), F.lit("-"), pad(month), F.lit("-"), pad(day))


def _written(c: Column, pattern: str, default_year: Column, check_calendar: bool) -> Column:
    rows = F.arrays_zip(
        extract_all(c, pattern, 1).alias("m"),
        extract_all(c, pattern, 2).alias("d"),
        extract_all(c, pattern, 3).alias("y"),
    )

    def one(x):
        year = F.coalesce(F.try_to_number(F.nullif(x["y"], F.lit("")), F.lit("9999")).cast("int"), default_year)
        day = x["d"].try_cast("int")
        text = _iso(year, _month_number(x["m"]), day)
        ok = day.between(1, 31)
        if check_calendar:
            ok = ok & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
        return F.when(ok, text)

    return F.array_compact(F.transform(rows, one))


def extract_dates(c: Column, default_year: Column | int = 2024) -> Column:
    """ISO, written and month/day/year dates of a sentence, in that order, repeats kept."""
    year = F.lit(default_year) if isinstance(default_year, int) else default_year
    written = (
        r"(?iU)\b(" + fixed.MONTH_NAMES + "|" + fixed.MONTH_SHORT + r")\.?\s+(\d{1,2})"
        r"(?:st|nd|rd|th)?(?:[,\s]+(\d{4}))?\b"
    )
    mdy = r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"

    def slashed(x):
        m, d, y = (x[k].try_cast("int") for k in ("m", "d", "y"))
        full = F.when(y < 100, y + 2000).otherwise(y)
        return F.when(m.between(1, 12) & d.between(1, 31), _iso(full, m, d))

    def found(p):
        pattern = p(mdy)
        slashes = F.array_compact(
            F.transform(
                F.arrays_zip(
                    extract_all(c, pattern, 1).alias("m"),
                    extract_all(c, pattern, 2).alias("d"),
                    extract_all(c, pattern, 3).alias("y"),
                ),
                slashed,
            )
        )
        # most sentences have none of these, which is far cheaper to see without reading three groups
        none = F.array().cast("array<string>")
        iso = extract_all(c, p(r"(?U)\b\d{4}-\d{2}-\d{2}\b"))
        months = F.when(c.isNull() | c.rlike(p(written)), _written(c, p(written), year, check_calendar=False)).otherwise(none)
        return F.concat(iso, months, F.when(c.isNull() | c.contains("/"), slashes).otherwise(none))

    return by_text(c, found)


def normalize_vague(expr: Column, ref: Column) -> Column:
    """struct<iso, confidence> of a vague expression against a date; NULL when no rule fits."""
    e = strip(expr)
    days = lambda n: F.date_sub(ref, n)
    months = lambda n: F.add_months(ref, -n)

    def back(unit, n):
        return (
            F.when(unit == "day", days(n))
            .when(unit == "week", days(n * 7))
            .when(unit == "month", months(n))
            .when(unit == "year", months(n * 12))
        )

    result = lambda d, conf: F.struct(
        d.cast("string").alias("iso"), F.lit(conf).alias("confidence")
    )
    quantified = r"(?iU)\b(\d+)\s+(day|week|month|year)s?\s+ago\b"
    amount = F.regexp_extract(e, quantified, 1)
    safe = F.when(F.length(amount) <= 5, amount).try_cast("int")
    out = F.when(
        e.rlike(quantified),
        result(back(F.lower(F.regexp_extract(e, quantified, 2)), safe), 0.95),
    )
    for words, n, conf in fixed.VAGUE_AMOUNTS:
        pattern = "(?iU)" + words + r"\s+(day|week|month)s?\s+ago\b"
        unit = F.lower(F.regexp_extract(e, pattern, 1))
        out = out.when(e.rlike(pattern), result(back(unit, F.lit(n)), conf))
    weekday = r"(?iU)\b(?:last|this\s+past)\s+(" + fixed.WEEKDAYS + r")\b"
    named = F.array_position(
        F.array(*[F.lit(d.lower()) for d in fixed.WEEKDAYS.split("|")]),
        F.lower(F.regexp_extract(e, weekday, 1)),
    ).cast("int") - 1
    gap = F.pmod(F.weekday(ref) - named, F.lit(7))
    out = out.when(
        e.rlike(weekday), result(days(F.when(gap == 0, F.lit(7)).otherwise(gap).cast("int")), 0.95)
    )
    first_of_month = F.trunc(ref, "month")
    simple = [
        ("yesterday", days(1)),
        ("today", ref),
        (r"the\s+other\s+day", days(3)),
        (r"not\s+long\s+ago", days(7)),
        ("recently", days(5)),
        (r"earlier\s+this\s+week", days(F.greatest(F.weekday(ref), F.lit(1)))),
        (r"earlier\s+this\s+month",
         F.date_add(first_of_month, F.greatest(F.lit(1), F.floor(F.dayofmonth(ref) / 2).cast("int")) - 1)),
        (r"last\s+week", days(7)),
        (r"last\s+month", months(F.lit(1))),
        (r"last\s+year", months(F.lit(12))),
        (r"this\s+week", days(F.weekday(ref))),
        (r"this\s+month", first_of_month),
        (r"this\s+year", F.trunc(ref, "year")),
    ]
    for words, when in simple:
        out = out.when(e.rlike(r"(?iU)\b" + words + r"\b"), result(when, 0.85))
    return out


def _relative(word: Column, ref: Column) -> Column:
    w = F.regexp_replace(F.lower(word), r"(?U)\s+", " ")
    capped = F.least(F.dayofmonth(ref), F.lit(28))
    in_month = lambda first: F.date_add(first, capped - 1)
    return (
        F.when(w == "yesterday", F.date_sub(ref, 1))
        .when(w == "today", ref)
        .when(w == "last week", F.date_sub(ref, 7))
        .when(w == "last month", in_month(F.add_months(F.trunc(ref, "month"), -1)))
        .when(w == "last year", in_month(F.add_months(F.trunc(ref, "month"), -12)))
        .when(w == "this week", F.date_sub(ref, F.weekday(ref)))
        .when(w == "this month", F.trunc(ref, "month"))
        .when(w == "this year", F.trunc(ref, "year"))
        .cast("string")
    )


def parse_dates(c: Column, ref: Column) -> Column:
    """Sorted distinct dates of a text; relative ones are resolved against a date column."""
    iso = extract_all(c, r"(?U)\b\d{4}-\d{2}-\d{2}\b")
    english = (
        r"(?iU)\b(" + fixed.MONTH_NAMES + "|" + fixed.MONTH_SHORT + r")\s+(\d{1,2})(?:,?\s+(\d{4}))?\b"
    )
    relative = F.transform(
        extract_all(c, r"(?iU)\b(?:yesterday|today|last\s+(?:week|month|year)|this\s+(?:week|month|year))\b"),
        lambda x: _relative(x, ref),
    )
    vague = F.transform(
        F.filter(
            F.transform(extract_all(c, fixed.VAGUE_DATE), lambda x: normalize_vague(x, ref)),
            lambda r: r["confidence"] > 0.7,
        ),
        lambda r: r["iso"],
    )
    everything = F.concat(iso, _written(c, english, F.year(ref), True), relative, vague)
    return F.array_sort(F.array_distinct(F.array_compact(everything)))


def vague_dates(c: Column, ref: Column) -> Column:
    """array<struct<iso,confidence>> of the vague expressions in reading order."""
    # every vague expression has one of these
    some = contains_any(F.lower(c), ["ago", "last", "this", "yesterday", "today", "recently", "other", "back"])
    found = F.when(c.isNull() | ~plain(c) | some, extract_all(c, fixed.VAGUE_DATE)).otherwise(F.array().cast("array<string>"))
    return F.filter(
        F.transform(found, lambda x: normalize_vague(x, ref)),
        lambda r: r.isNotNull(),
    )


def annotate_vague_dates(c: Column, ref: Column) -> Column:
    """Every vague expression becomes ``on ISO-DATE (expression)``."""
    gaps = F.split(c, fixed.VAGUE_DATE, -1)
    marked = F.transform(
        extract_all(c, fixed.VAGUE_DATE),
        lambda m: F.coalesce(
            F.concat(F.lit("on "), normalize_vague(m, ref)["iso"], F.lit(" ("), m, F.lit(")")), m
        ),
    )
    joined = F.array_join(
        F.zip_with(gaps, marked, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), ""
    )
    return F.when(ref.isNull(), c).otherwise(joined)


def session_date(c: Column) -> Column:
    """Date of a session stamp such as ``2023/05/28 (Sun) 21:04``."""
    head = first_match(strip(c), r"^\d{4}[/-]\d{2}[/-]\d{2}")
    return F.try_to_date(F.translate(head, "/", "-"), "yyyy-MM-dd")


def session_timestamp(c: Column) -> Column:
    """Session stamp with its hour and minute when given."""
    pattern = r"^(\d{4})[/-](\d{2})[/-](\d{2})(?:\s*\([A-Za-z]{3}\))?(?:[\sT]+(\d{2}):(\d{2}))?"
    part = lambda g: F.regexp_extract(strip(c), pattern, g)
    clock = F.when(part(4) != "", F.concat(part(4), F.lit(":"), part(5))).otherwise("00:00")
    return F.try_to_timestamp(
        F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), clock),
        F.lit("yyyy-MM-dd HH:mm"),
    )


def expand_chained_dates(c: Column) -> Column:
    """``N day|week|month after|before ISO`` as ISO dates; a month counts 30 days."""
    pattern = r"(?iU)\b(\d+)\s+(day|days|week|weeks|month|months)\s+(after|before)\s+(\d{4}-\d{2}-\d{2})\b"
    groups = F.arrays_zip(
        *[extract_all(c, pattern, g).alias(n) for g, n in ((1, "n"), (2, "u"), (3, "d"), (4, "a"))]
    )

    def one(x):
        unit = F.lower(x["u"])
        step = F.when(unit.startswith("day"), 1).when(unit.startswith("week"), 7).otherwise(30)
        n = F.when(F.length(x["n"]) <= 5, x["n"]).try_cast("int") * step
        sign = F.when(F.lower(x["d"]) == "after", 1).otherwise(-1)
        return F.date_add(F.try_to_date(x["a"], "yyyy-MM-dd"), n * sign).cast("string")

    return F.array_compact(F.transform(groups, one))


def event_dates(sentence: Column, ref: Column) -> Column:
    """Dates of a sentence for the event table: parsed ones, then new chained ones."""
    found = parse_dates(sentence, ref)
    return F.concat(found, F.array_except(expand_chained_dates(sentence), found))


def event_sentences(c: Column) -> Column:
    return F.split(c, r"(?U)(?<=[.!?\n])\s+", -1)


def has_date_expression(c: Column) -> Column:
    return c.rlike(fixed.DATE_EXPRESSION)


def recency_boost(day: Column, ref: Column) -> Column:
    """Multiplier of a document date; 1.0 when it is missing or no date."""
    age = F.datediff(ref, day)
    return (
        F.when(age <= 2, 1.8).when(age <= 5, 1.4).when(age <= 14, 1.2).otherwise(1.0)
    )


def recency_decay(day: Column, ref: Column, half_life_days: float = fixed.RECENCY_HALF_LIFE_DAYS) -> Column:
    """2^(-age/half life); future and undated rows keep 1.0."""
    age = F.datediff(ref, day)
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.when(age > 0, F.pow(F.lit(2.0), -age / half_life_days)).otherwise(1.0)


def date_contexts(c: Column) -> Column:
    """array<struct<date,context>> of the ISO dates with the text around them."""
    return F.transform(
        spans(c, r"\d{4}-\d{2}-\d{2}"),
        lambda s: F.struct(
            s["text"].alias("date"),
            strip(window_text(c, s["start"] - 50, s["stop"] + 100)).alias("context"),
        ),
    )


def date_phase(day: Column) -> Column:
    """Angle of a date on the yearly circle; 0 when it is no date."""
    return F.coalesce(2 * F.pi() * F.dayofyear(day) / 365.25, F.lit(0.0))


def trace_tier(modified: Column, now: Column) -> Column:
    """hot up to 24 hours, warm up to 7 days, else cold."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(modified.cast("timestamp"))) / 3.6e9
    return F.when(hours <= 24, "hot").when(hours <= 168, "warm").otherwise("cold")


def tier_weight(tier: Column) -> Column:
    out = F.when(tier == "hot", fixed.TIER_WEIGHTS["hot"])
    return out.when(tier == "warm", fixed.TIER_WEIGHTS["warm"]).otherwise(fixed.TIER_WEIGHTS["cold"])


def is_ordering_question(c: Column) -> Column:
    return contains_any(F.lower(c), fixed.ORDERING_WORDS)


def is_update_question(c: Column) -> Column:
    return contains_any(F.lower(c), fixed.UPDATE_WORDS)


def feed_timestamp(raw: Column) -> Column:
    """Seconds since the epoch from seconds, milliseconds or ISO text; 0.0 when unreadable."""
    text = strip(raw)
    number = text.try_cast("double")
    # text without an offset is UTC, whatever the session's time zone
    zoned = (
        F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), text)
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
        .otherwise(F.concat(text, F.lit("Z")))
    )
    iso = F.unix_micros(F.try_to_timestamp(zoned)) / 1e6
    value = F.coalesce(number, iso, F.lit(0.0))
    return F.when(value > 1e10, value / 1000.0).otherwise(value)


