"""Quality metrics: risk-coverage, agreement, failures, frontiers, presentation, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.common import contains_any, extract_all, overlap
from ..plans.ordered import running_sums
from ..plans.scale import best_per_key
from ..plans.skyline import RANGE, skyline
from .index import unnest
from .ledger import norm_axis

# ---- risk and coverage ----------------------------------------------------------------------------


def risk_curve(outcomes: DataFrame, tie: str = "id") -> DataFrame:
    """(id, answered, coverage, accuracy, risk) along falling confidence; ties keep ``tie`` order."""
    n = outcomes.agg(F.count("*")).scalar()
    sums = running_sums(
        outcomes, [], [F.desc("confidence"), F.asc(tie)],
        {"answered": F.lit(1), "right": F.col("correct").cast("int")},
    )
    accuracy = F.col("right") / F.col("answered")
    return sums.select(
        tie, "answered", (F.col("answered") / n).alias("coverage"), accuracy.alias("accuracy"), (1.0 - accuracy).alias("risk")
    )


def risk_summary(curve: DataFrame, target: float = 0.9) -> DataFrame:
    """One row: total, accuracy at full coverage, area under the curve, coverage at a target.

    The trapezoids share their width, so the area is the mean risk without half of both ends.
    """
    one = curve.agg(
        F.count("*").alias("total"), F.sum("risk").alias("s"),
        F.min_by("risk", "answered").alias("first"), F.max_by("risk", "answered").alias("last"),
        F.max_by("accuracy", "answered").alias("accuracy"),
        F.max(F.when(F.col("accuracy") >= target, F.col("coverage"))).alias("c"),
    )
    area = (F.col("s") - (F.col("first") + F.col("last")) / 2) / F.col("total")
    return one.select(
        "total", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.when(F.col("total") == 1, F.col("first")).when(F.col("total") > 1, area).otherwise(0.0).alias("aurc"),
        F.coalesce("c", F.lit(0.0)).alias("coverage_at_target"),
    )


def judge_agreement(pairs: DataFrame) -> DataFrame:
    """One row of agreement between (reference, candidate); an empty candidate is unanswered."""
    r, c = F.col("reference"), F.col("candidate")
    count = lambda x: F.count_if(x)
    one = pairs.agg(
        F.count("*").alias("pairs"), F.count("candidate").alias("n"), count(r & c).alias("yes"), count(~r & ~c).alias("no"),
        count(r & c.isNotNull()).alias("ry"), count(c).alias("cy"),
    )
    n, ry, cy = F.col("n"), F.col("ry"), F.col("cy")
    observed = (F.col("yes") + F.col("no")) / n
    chance = (ry * cy + (n - ry) * (n - cy)) / (n * n)
    some = n > 0
    return one.select(
        "pairs", n.alias("answered"), (F.col("pairs") - n).alias("unanswered"),
        F.when(some, F.round(observed, 4)).otherwise(0.0).alias("agreement"),
        F.when(some & (ry > 0), F.round(F.col("yes") / ry, 4)).alias("positive_agreement"),
        F.when(some & (n > ry), F.round(F.col("no") / (n - ry), 4)).alias("negative_agreement"),
        F.when(some & (chance != 1.0), F.round((observed - chance) / (1.0 - chance), 4)).alias("cohen_kappa"),
        some.alias("measured"),
    )


# ---- recall aggregates ------------------------------------------------------------------------------


def overall_and(df: DataFrame, key: str, aggs: list[Column], total: str = "overall", more: list[str] | None = None) -> DataFrame:
    """Aggregates per key value and once over all of them, in one pass of grouping sets."""
    more = more or []
    cols = [F.col(c) for c in more]
    return df.groupingSets([[*cols, F.col(key)], cols], *cols, F.col(key)).agg(
        F.grouping(key).alias("_g"), *aggs
    ).withColumn(key, F.when(F.col("_g") == 1, total).otherwise(F.col(key))).drop("_g")


def gold_recall(selected: Column, gold: Column) -> Column:
    """Share of gold sessions among the selected ones; 1.0 without gold."""
    wanted = F.array_distinct(F.array_compact(gold))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(overlap(wanted, selected) / F.size(wanted))


def recall_curve(ranked: Column, gold: Column, ns: tuple[int, ...]) -> list[Column]:
    return [gold_recall(F.slice(ranked, 1, n), gold).alias(f"recall_{n}") for n in ns]


def recall_aggregate(records: DataFrame, ns: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Mean recall at each depth, share of full recall and mean candidates, per type and overall.

    ``records`` has qtype, candidates and recall_N columns.
    """
    top = f"recall_{max(ns)}"
    aggs = [F.count("*").alias("n"), *[F.avg(f"recall_{n}").alias(f"mean_{n}") for n in ns]]
    aggs += [F.avg((F.col(top) >= 1.0).cast("double")).alias(f"full_{max(ns)}"), F.avg("candidates").alias("mean_candidates")]
    return overall_and(records, "qtype", aggs)


def recall_deltas(canonical: DataFrame, degraded: DataFrame, ns: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Loss of mean recall per type present in both aggregates."""
    d = degraded.select("qtype", *[F.col(f"mean_{n}").alias(f"_d{n}") for n in ns])
    return canonical.join(d, "qtype").select(
        "qtype", *[(F.col(f"mean_{n}") - F.col(f"_d{n}")).alias(f"delta_{n}") for n in ns]
    )


def worst_hit(deltas: DataFrame, n: int = 10) -> DataFrame:
    return deltas.where("qtype <> 'overall'").orderBy(F.desc(f"delta_{n}"), "qtype").limit(1)


def ablation(rows: DataFrame) -> DataFrame:
    """Mean recall and count per configuration and type, with ``_overall`` per configuration."""
    return overall_and(rows, "qtype", [F.avg("recall").alias("mean"), F.count("*").alias("n")], "_overall", ["config"])


def coverage_buckets(failed: DataFrame, sessions: DataFrame) -> DataFrame:
    """(question_id, question_type, coverage): share of answer sessions the hypothesis touches.

    ``failed`` has question_id, question_type, hypothesis, answer_session_ids; ``sessions`` has
    question_id, session_id, text.  A session counts with two common words of four letters.
    """
    words = lambda c: F.array_distinct(F.transform(extract_all(c, r"(?U)\b[A-Za-z]{4,}\b"), F.lower))
    h = failed.select("question_id", "question_type", words(F.col("hypothesis")).alias("h"), F.array_distinct("answer_session_ids").alias("ids"), F.size("answer_session_ids").alias("n")).where(
        "size(h) > 0 and n > 0"
    )
    asked = h.select("question_id", F.explode("ids").alias("session_id"), "h")
    hit = asked.join(sessions, ["question_id", "session_id"]).where(overlap(F.col("h"), words(F.col("text"))) >= 2)
    per = hit.groupBy("question_id").agg(F.count_distinct("session_id").alias("covered"))
    return h.join(per, "question_id", "left").select(
        "question_id", "question_type", (F.coalesce("covered", F.lit(0)) / F.col("n")).alias("coverage")
    )


# ---- failures ---------------------------------------------------------------------------------------


def failure_type(correct: Column, diagnostics: Column) -> Column:
    """Class of one judged row from its retrieval diagnostics struct."""
    some = lambda c: F.size(F.coalesce(diagnostics[c], F.array().cast("array<string>"))) > 0
    recall = diagnostics["answer_session_recall"]
    return (
        F.when(F.coalesce(correct, F.lit(False)), "correct")
        .when(diagnostics.isNull(), "missing_diagnostics")
        .when(recall.isNull(), "missing_answer_sessions")
        .when(recall >= 1.0, "synthesis_failure")
        .when(some("session_limited_answer_session_ids"), "session_limit_miss")
        .when(some("budget_dropped_answer_session_ids"), "char_budget_miss")
        .otherwise("retrieval_ranking_miss")
    )


def failure_counts(classified: DataFrame) -> DataFrame:
    """(question_type, failure_type, n) with an overall group."""
    return overall_and(classified, "question_type", [F.count("*").alias("n")], more=["failure_type"])


# ---- frontier ------------------------------------------------------------------------------------------


def pareto_frontier(points: DataFrame, group: str = "benchmark", size: int = RANGE) -> DataFrame:
    """Add ``frontier``: not dominated on accuracy, points per 1,000 tokens and latency; incomplete points are never on it."""
    per_k = F.round(F.col("accuracy") * 1000.0 / F.when(F.col("tokens_total") > 0, F.col("tokens_total")), 3)
    full = points.withColumn("efficiency", per_k)
    measures = {"grp": F.col(group), "x": F.col("accuracy").cast("double"), "y": F.col("efficiency").cast("double"), "z": F.col("p95_latency_ms").cast("double")}
    live = full.select(*[e.alias(n) for n, e in measures.items()]).where("x is not null and y is not null and z is not null")
    best = skyline(live, size).withColumn("_f", F.lit(True))
    same = F.lit(True)
    for n, e in measures.items():
        same = same & (e.eqNullSafe(best[n]) if n == "grp" else e == best[n])
    return full.join(best, same, "left").drop(*[best[n] for n in measures]).withColumn("frontier", F.coalesce("_f", F.lit(False))).drop("_f")


# ---- presentation and validity -----------------------------------------------------------------------------


def presentation(kind: Column, status: Column, admission: Column, freshness: Column) -> Column:
    """validated, boundary or refuted from the four axes of a finding."""
    k, s, a, f = (norm_axis(c) for c in (kind, status, admission, freshness))
    unknown = ~F.coalesce(
        k.isin(fixed.EVIDENCE_KINDS) & s.isin(fixed.CLAIM_STATUSES) & a.isin(fixed.ADMISSIONS), F.lit(False)
    )
    fresh = f.isNull() | (f == "verified-at-source")
    return (
        F.when(unknown, "boundary")
        .when((k == "falsified") | (s == "refuted"), "refuted")
        .when(k == "producer-asserted", "boundary")
        .when((s == "reference-validated") & (a == "admitted") & fresh, "validated")
        .otherwise("boundary")
    )


def stored_presentation(kind: Column, status: Column, verdict: Column, freshness: Column) -> Column:
    admission = F.when(norm_axis(verdict) == "accept", "admitted").otherwise("floored")
    return presentation(kind, status, admission, freshness)


def synthesis_mode(modes: DataFrame, key: str) -> DataFrame:
    """Weakest mode among the inputs of each synthesis."""
    rank = F.when(F.col("mode") == "validated", 2).when(F.col("mode") == "refuted", 0).otherwise(1)
    low = F.min(rank)
    return modes.groupBy(key).agg(
        F.when(low == 2, "validated").when(low == 0, "refuted").otherwise("boundary").alias("mode")
    )


def valid_as_of(findings: DataFrame, as_of: Column, void: DataFrame) -> DataFrame:
    """Add ``verdict``: verified findings that are void, inactive or outside their interval are ungraded.

    ``findings`` has content_digest, base_verdict, lifecycle, valid_from, valid_to (NULL is open);
    ``void`` lists voided and superseded digests.
    """
    gone = void.select("content_digest").distinct().withColumn("_void", F.lit(True))
    inside = F.coalesce(as_of >= F.col("valid_from"), F.lit(True)) & F.coalesce(as_of <= F.col("valid_to"), F.lit(True))
    good = F.col("_void").isNull() & (norm_axis(F.col("lifecycle")) == "active") & inside
    verdict = F.when(F.col("base_verdict") != "verified", F.col("base_verdict")).otherwise(
        F.when(F.coalesce(good, F.lit(False)), "verified").otherwise("ungraded")
    )
    return findings.join(gone, "content_digest", "left").withColumn("verdict", verdict).drop("_void")


# ---- reports ------------------------------------------------------------------------------------------------


def benchmark_report(rows: DataFrame) -> DataFrame:
    """Score, latency and token figures per category and overall; unjudged rows do not count.

    ``rows`` has category, judge_label, latency_ms, tokens.  Quantiles are nearest-rank.
    """
    judged = rows.where(F.col("judge_label").isNotNull())
    nearest = lambda q: F.expr(f"percentile_disc({q}) within group (order by latency_ms)")
    out = overall_and(
        judged, "category",
        [
            F.count("*").alias("total"), F.count_if("judge_label").alias("correct"),
            F.round(F.avg("latency_ms"), 3).alias("latency_mean"), F.round(F.median("latency_ms"), 3).alias("latency_p50"),
            F.round(nearest(0.95), 3).alias("latency_p95"), F.sum("tokens").alias("tokens"),
        ],
    )
    return out.withColumn("accuracy", F.round(100.0 * F.col("correct") / F.col("total"), 1))


def scorecard(accuracy: DataFrame, egress: DataFrame, lineage: DataFrame, fleet: DataFrame) -> DataFrame:
    """One row from the one-row summaries of a run."""
    out = accuracy
    for part in (egress, lineage, fleet):
        for name in part.columns:
            out = out.withColumn(name, part.select(name).scalar())
    return out


def endpoint_class(endpoint: Column) -> Column:
    """local only for loopback hosts and on-device runtimes; cloud otherwise."""
    text = F.lower(F.trim(endpoint))
    host = F.regexp_extract(text, r"^(?:https?|wss?)://(?:[^/@?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    loopback = host.rlike(r"^(?:localhost|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|0\.0\.0\.0|\[(?:::1|::)\])$")
    markers = [
        "localhost", "127.0.0.1", "0.0.0.0", "::1", "ollama", "llama.cpp", "llamacpp", "file://", "unix:", "null", "in-process",
    ]
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "cloud")
        .when(text.rlike(r"^(?:https?|wss?):"), F.when(loopback, "local").otherwise("cloud"))
        .when(contains_any(text, markers), "local")
        .otherwise("cloud")
    )


def egress_audit(calls: DataFrame) -> DataFrame:
    """One row: whether a run stayed local, calls and cloud calls."""
    cloud = endpoint_class(F.col("endpoint")) == "cloud"
    return calls.agg(
        (F.count_if(cloud) == 0).alias("pure_local"), F.count("*").alias("total_calls"), F.count_if(cloud).alias("cloud_calls")
    )


def provenance_nodes(notes: DataFrame) -> DataFrame:
    """(id, origin, parent): first ``derived_from`` target; the last row of a repeated id counts."""
    targets = F.filter("links", lambda x: (x["type"] == "derived_from") & (F.coalesce(x["target"], F.lit("")) != ""))
    rows = notes.select(
        "id", (F.col("source_quality") == "stated").alias("origin"), F.get(targets, F.lit(0))["target"].alias("parent"), "pos"
    )
    return best_per_key(rows, ["id"], [F.desc("pos")]).drop("pos")


# ---- research measures on tables ----------------------------------------------------------------------------------

HASH_PRIMES = (7919, 104729, 15485863, 32452843, 49979687, 67867967, 86028121)


def _digest_mod(c: Column, n: int) -> Column:
    """md5 of a string as a number, modulo n (n below 2^30)."""
    out = F.lit(0).cast("long")
    shift = (1 << 32) % n
    for i in range(4):
        word = F.conv(F.substring(F.md5(c), 1 + 8 * i, 8), 16, 10).cast("long")
        out = (out * shift + word) % n
    return out


def hash_patterns(texts: DataFrame, size: int) -> DataFrame:
    """(id, idx, value): saturating hash pattern, +0.15 per word hit and +0.25 per bigram hit."""
    from ..functions import text as T

    t = F.col("_t")
    rows = texts.select("id", T.trace_tokens(F.col("text")).alias("_t"))
    grams = rows.select("id", unnest(T.bigrams(t), "w"), F.lit(0.25).alias("v"), F.lit(5).alias("k"))
    words = rows.select("id", unnest(t, "w"), F.lit(0.15).alias("v"), F.lit(len(HASH_PRIMES)).alias("k"))
    both = words.unionByName(grams).where("w is not null").groupBy("id", "w", "v", "k").agg(F.count("*").alias("n"))
    primes = F.array(*[F.lit(p).cast("long") for p in HASH_PRIMES])
    hits = both.select("id", "v", "n", _digest_mod(F.col("w"), size).alias("d"), F.explode(F.slice(primes, F.lit(1), F.col("k"))).alias("p"))
    return hits.groupBy("id", ((F.col("d") + F.col("p")) % size).alias("idx")).agg(
        F.least(F.lit(1.0), F.sum(F.col("v") * F.col("n"))).alias("value")
    )


def temporal_signature(spikes: DataFrame, steps: int, bins: int = 8) -> DataFrame:
    """(neuron, bin, n): spikes per part of the run; the first ``steps % bins`` parts are one longer."""
    small, longer = steps // bins, steps % bins
    edge = longer * (small + 1)
    part = F.when(F.col("step") < edge, F.floor(F.col("step") / (small + 1))).otherwise(
        longer + F.floor((F.col("step") - edge) / max(small, 1))
    )
    return spikes.groupBy("neuron", part.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def recurrence_ratio(currents: DataFrame) -> DataFrame:
    outer = F.avg(F.abs("input"))
    return currents.agg(F.when(outer > 0, F.avg(F.abs("recurrent")) / outer).otherwise(0.0).alias("ratio"))


def order_parameter(phases: DataFrame) -> DataFrame:
    """Phase coherence: length of the mean unit vector."""
    return phases.agg(
        F.sqrt(F.pow(F.avg(F.cos("phase")), 2) + F.pow(F.avg(F.sin("phase")), 2)).alias("coherence")
    )


def continuity_score(focus: Column, concerns: Column, momentum: Column, decisions: Column, context: Column) -> Column:
    """Share of a previous state (focus 3, momentum 2, each concern and decision 1) in a context."""
    low = F.lower(context)
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda w: (F.length(w) > 3) & low.contains(w))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    count = lambda a: F.size(F.filter(a, lambda x: F.size(words(x)) > 0))
    none = F.array().cast("array<string>")
    cs, ds = F.coalesce(concerns, none), F.coalesce(decisions, none)
    hits = (
        F.when(given(focus), F.least(F.lit(3), F.size(words(focus)))).otherwise(0) + count(cs)
        + F.when(given(momentum), F.least(F.lit(2), F.size(words(momentum)))).otherwise(0) + count(ds)
    )
    total = F.when(given(focus), 3).otherwise(0) + F.size(cs) + F.when(given(momentum), 2).otherwise(0) + F.size(ds)
    return F.when(given(context), hits / F.greatest(total, F.lit(1))).otherwise(0.0)


def paired_interval(pairs: DataFrame, samples: int = 1000, seed: int = 20260714) -> DataFrame:
    """Mean difference with 2.5 and 97.5 percent bootstrap bounds over (id, trained, control).

    Every row enters every resample with a Poisson(1) weight derived from its id, so resamples are
    sums over the table and no task holds all rows.  Bounds agree with drawing with replacement up
    to sampling noise; they are not seed-exact.
    """
    d = F.col("trained") - F.col("control")
    u = (F.xxhash64("id", "r", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("u")
    rows = pairs.select("id", d.alias("d")).select("id", "d", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("r"))
    rows = rows.select("r", "d", u)
    cuts = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1)) or 1) for k in range(12)])
    weight = sum(((F.col("u") >= F.lit(float(c))).cast("int") for c in cuts), F.lit(0))
    means = rows.groupBy("r").agg((F.sum(F.col("d") * weight) / F.greatest(F.sum(weight), F.lit(1))).alias("m"))
    bounds = means.agg(F.expr("percentile(m, 0.025)").alias("lower"), F.expr("percentile(m, 0.975)").alias("upper"))
    one = pairs.agg(F.avg(d).alias("mean"), F.count("*").alias("pairs"))
    return one.withColumn("lower", bounds.select("lower").scalar()).withColumn("upper", bounds.select("upper").scalar())


def hub_graph(edges: DataFrame, top: int = 20, per_hub: int = 5) -> DataFrame:
    """Strongest edges of the nodes with the largest total weight: (src, dst, weight).

    ``edges`` has src, dst, weight; weights are divided by the largest one.
    """
    from ..plans.scale import top_per_key

    peak = edges.agg(F.max("weight")).scalar()
    scaled = edges.select("src", "dst", (F.col("weight") / peak).alias("weight"))
    hubs = scaled.groupBy("src").agg(F.round(F.sum("weight"), 9).alias("strength")).orderBy(F.desc("strength"), "src").limit(top)
    own = scaled.join(hubs.select("src"), "src", "left_semi").where("src <> dst and weight >= 0.001")
    return top_per_key(own, ["src"], [F.desc("weight"), F.asc("dst")], per_hub).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.round("weight", 4).alias("weight")
    ).distinct()
