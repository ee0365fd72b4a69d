"""Quality rules on documents, judged together with the host they come from.

Every document is measured in its own row with built-in functions: words, their characters,
symbols, repeated lines and words in repeated three-word windows.  A few measures are the base rules,
which reject a document by themselves.  The other rules are too weak for that; their failures are
counted per host, the rates of a host are drawn towards the mean of all hosts with a beta prior
whose two parameters come from the hosts themselves (by moments).  What a host's rate says about a failure of its documents
is the posterior chance that the rate is above the corpus mean: a host for which that chance is at least ``CHANCE`` is no better
than others, and bad for the rule; one that is credibly better keeps its few failing documents.  The verdict goes back to the
documents: one that fails the rule is rejected if its host is bad for it.  A document that fails no rule stays, whatever its host.

Defined results: null and empty texts have no words and fail the base rules.  A null host is a host
of its own.  Repeated rows are judged one by one.  Texts of any length are measured whole.  An empty
table gives no rows.  The frame's own columns stay; names that clash get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import table
from .registry import query

#: a text with fewer words fails
LEAST_WORDS = 50
#: at most this percentage of words may stand in repeated windows
MOST_REPEATED = 50
#: symbols that are counted, each by itself
SYMBOLS = "#*$%&|<>"
#: weak rules: name -> failure of a document
RULES: dict[str, str] = {
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 14 * n_words",
}
#: a host is bad for a rule unless its rate exceeds the corpus mean with less than this chance, and that many deviations
CHANCE, DEVIATIONS = 0.05, 1.645
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    blank = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.length(blank) == 0, F.array().cast("array<string>")).otherwise(F.split(blank, " +"))


def _neighbours(sorted_: Column, key) -> Column:
    """Elements of a sorted array whose key equals that of the one before or after."""
    same = lambda x, i, d: F.coalesce(key(F.get(sorted_, i + F.lit(d))) == key(x), F.lit(False))
    return F.filter(sorted_, lambda x, i: same(x, i, -1) | same(x, i, 1))


def repeated_window_words(words: Column, n: Column, hashes: Column, name: str) -> list[tuple[str, Column]]:
    """Steps, each a column on the ones before, that end in the words within repeated three-word windows.

    Windows that share 32 bits of a hash are candidates (one sort of primitive longs); only these
    are compared as text.  A place is kept in the low 32 bits.
    """
    low = F.lit((1 << 32) - 1)
    packed = F.when(
        n < 3, F.array().cast("array<bigint>")
    ).otherwise(
        F.sort_array(F.transform(
            F.sequence(F.lit(0), n.cast("int") - 3),
            lambda i: F.coalesce(F.shiftleft(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)), 32).bitwiseOR(i.cast("long")), F.lit(0)),
        ))
    )
    p, c, e = (f"{name}_{x}" for x in ("packed", "near", "equal"))
    text = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    place = lambda x: x.bitwiseAND(low).cast("int")
    exact = F.array_sort(F.transform(F.col(c), lambda x: F.struct(text(place(x)).alias("t"), place(x).alias("i"))))
    found = F.sort_array(F.transform(_neighbours(F.col(f"{e}_sorted"), lambda x: x["t"]), lambda x: x["i"]))
    # each place covers three words, less those that the next place covers
    covered = F.aggregate(
        F.col(e), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return [
        (p, packed), (c, _neighbours(F.col(p), lambda x: F.shiftright(x, 32))), (f"{e}_sorted", exact), (e, found),
        (name, F.when(F.size(e) == 0, F.lit(0).cast("long")).otherwise(covered)),
    ]


def measures(docs: DataFrame, text: Column) -> DataFrame:
    """Add MEASURES to the frame, everything within the row.

    Each step is a projection of its own, so that no expression is evaluated more than once.
    """
    own = docs.columns
    taken = {c.lower() for c in own}
    prefix = "q"
    while any(c.startswith(f"{prefix}_") for c in taken):
        prefix += "q"
    name = lambda x: f"{prefix}_{x}"
    lines = F.filter(F.split(F.col(name("text")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    stages: list[list[tuple[str, Column]]] = [
        [(name("text"), F.coalesce(text.cast("string"), F.lit("")))],
        [(name("words"), words_of(F.col(name("text")))), (name("lines"), lines),
         (name("symbols"), (F.length(name("text")) - F.length(F.translate(name("text"), SYMBOLS, ""))).cast("long")),
         (name("chars"), F.length(F.translate(name("text"), " \t\n\x0b\x0c\r", "")).cast("long"))],
        [(name("n"), F.size(name("words")).cast("long")), (name("n_lines"), F.size(name("lines")).cast("long")),
         (name("dup"), (F.size(name("lines")) - F.size(F.array_distinct(name("lines")))).cast("long")),
         (name("hashes"), F.transform(name("words"), lambda w: F.xxhash64(w)))],
    ]
    stages += [[s] for s in repeated_window_words(F.col(name("words")), F.col(name("n")), F.col(name("hashes")), name("rep"))]
    df = docs
    for stage in stages:
        df = df.select("*", *[c.alias(a) for a, c in stage])
    shown = dict(zip(MEASURES, ("n", "chars", "symbols", "n_lines", "dup", "rep"), strict=True))
    return df.select(*[F.col(f"`{c}`") for c in own], F.struct(*[F.col(name(v)).alias(k) for k, v in shown.items()]).alias(name("m")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def host_rates(failures: DataFrame, rules: list[str]) -> DataFrame:
    """(host, rule, n, failed, prior_a, prior_b, rate, corpus) from counts (host, n, <rule>...); ``corpus`` is the mean rate.

    The prior of a rule has the mean of all documents and the strength that the spread of the hosts'
    rates implies: a + b = m(1-m)/v - 1, where v is the variance between hosts beyond what counting
    alone gives, at least one document's worth and at most the mean host's.
    """
    long = failures.select(
        "host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in rules])).alias("x")
    ).select("host", "n", "x.rule", "x.failed")
    share = F.col("failed") / F.col("n")
    mean = long.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("m"), F.avg("n").alias("size"), F.avg(F.lit(1.0) / F.col("n")).alias("inverse"),
        F.avg(share).alias("mu"), F.avg(share * share).alias("square"),
    )
    between = F.col("square") - F.col("mu") * F.col("mu") - F.col("m") * (F.lit(1.0) - F.col("m")) * F.col("inverse")
    strength = F.when(between > 0, F.col("m") * (F.lit(1.0) - F.col("m")) / between - F.lit(1.0)).otherwise(F.col("size"))
    prior = mean.withColumn("strength", F.greatest(F.lit(1.0), F.least(strength, F.col("size"))))
    return long.join(prior, "rule").select(
        "host", "rule", "n", "failed", (F.col("m") * F.col("strength")).alias("prior_a"), ((F.lit(1.0) - F.col("m")) * F.col("strength")).alias("prior_b"),
        ((F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate"),
        F.col("m").alias("corpus"),
    )


def no_better() -> Column:
    """Whether the posterior leaves a chance of ``CHANCE`` that the host's rate is above the corpus mean (normal approximation)."""
    rate, size = F.col("rate"), F.col("n") + F.col("prior_a") + F.col("prior_b")
    return rate + F.lit(DEVIATIONS) * F.sqrt(rate * (F.lit(1.0) - rate) / (size + F.lit(1.0))) >= F.col("corpus")


def judge(docs: DataFrame, text_column: str = "text", host_column: str = "source", rules: dict[str, str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``judged``: a struct of MEASURES, base_failed, failed, host_bad and kept.

    The text is measured twice, once for the hosts' counts and once for the documents, rather than
    carried through a shuffle; hosts are counted with partial sums, so a hot host is one row a task.
    """
    rules = RULES if rules is None else rules
    names = list(rules)
    measured = measures(docs, F.col(text_column))
    m = measured.columns[-1]
    inside = {k: F.expr(_on_struct(sql, m)) for k, sql in rules.items()}
    counts = (
        measured.select(F.col(f"`{host_column}`").cast("string").alias("host"), *[v.cast("int").alias(k) for k, v in inside.items()])
        .groupBy("host").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in names])
    )
    # written, so that Spark knows its size and need not shuffle texts by host to learn it
    bad = settle(
        host_rates(counts, names).where(no_better()).groupBy("host")
        .agg(F.sort_array(F.collect_set("rule")).alias("bad"))  # at most one entry per rule
        .select(F.col("host").alias(f"{m}_host"), F.col("bad").alias(f"{m}_bad"))
    )
    none = F.array().cast(T.ArrayType(T.StringType()))
    own = [F.col(f"`{c}`") for c in docs.columns]
    joined = measured.join(bad, F.col(f"`{host_column}`").cast("string").eqNullSafe(F.col(f"{m}_host")), "left")
    failed = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in inside.items()]))
    host_bad = F.coalesce(F.col(f"{m}_bad"), none)
    base = base_failed(F.col(m))
    return joined.select(
        *own,
        F.struct(
            *[F.col(m)[x].alias(x) for x in MEASURES], base.alias("base_failed"), failed.alias("failed"), host_bad.alias("host_bad"),
            (~base & ~F.arrays_overlap(failed, host_bad)).alias("kept"),
        ).alias("judged" if "judged" not in {c.lower() for c in docs.columns} else f"{m}_judged"),
    )


def _on_struct(sql: str, struct: str) -> str:
    for x in MEASURES:
        sql = sql.replace(x, f"{struct}.{x}")
    return sql


_W = "[^\\x20\\x09-\\x0D]+"
OP3_SQL = f"""with d as (
  select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_W}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) as l from documents),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select rid, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select rid, i from g qualify count(*) over (partition by rid, k) > 1),
c as (select rid, count(distinct i + o) as n from r, (values (0), (1), (2)) v(o) group by rid),
m as (select d.rid, doc_id, host, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
  coalesce(c.n, 0) as n_repeat_words from d left join c on d.rid = c.rid),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 10 * n_symbols > 3 * n_words as symbols,
  100 * n_dup_lines > 30 * n_lines as lines, word_chars < 2 * n_words or word_chars > 14 * n_words as word_length from m),
h as (unpivot (select host, count(*)::double as n, sum(symbols::int)::double as symbols, sum(lines::int)::double as lines, sum(word_length::int)::double as word_length from f group by host)
  on symbols, lines, word_length into name rule value failed),
p as (select rule, sum(failed) / sum(n) as m, avg(n) as size, avg(failed / n * failed / n) - avg(failed / n) ** 2 - sum(failed) / sum(n) * (1 - sum(failed) / sum(n)) * avg(1 / n) as v from h group by rule),
s as (select *, greatest(1, least(case when v > 0 then m * (1 - m) / v - 1 else size end, size)) as k from p),
q as (select host, rule, n, k, m, (failed + m * k) / (n + k) as rate from h join s using (rule)),
b as (select host, rule from q where rate + {DEVIATIONS} * sqrt(rate * (1 - rate) / (n + k + 1)) >= m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed
  and not (symbols and exists (select 1 from b where b.host is not distinct from f.host and rule = 'symbols'))
  and not (lines and exists (select 1 from b where b.host is not distinct from f.host and rule = 'lines'))
  and not (word_length and exists (select 1 from b where b.host is not distinct from f.host and rule = 'word_length')) as kept from f"""


@query("op3_hostrules", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return judge(docs).select(
        "doc_id", *[F.col("judged")[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    )
