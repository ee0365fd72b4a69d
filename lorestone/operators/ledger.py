"""Feeds, write contract, recall ledger, outcome matching, calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import schemas
from ..functions import dates as D
from ..functions import fixed
from ..functions.common import strip, str_array
from ..plans.ordered import row_index, running_sums
from ..plans.scale import growing
from ..plans.scoped import CELLS, in_blocks, postings, shared_keys

# ---- feed rows -------------------------------------------------------------------------------------


def project_slug(c: Column, default: str = "GENERAL", presence: str = "presence@") -> Column:
    """Upper-case project of a sender such as ``project/actor`` or ``presence@project``."""
    t = strip(F.coalesce(c, F.lit("")))
    segment = (
        F.when(F.lower(t).startswith(presence), F.regexp_replace(t, "^[^@]*@", ""))
        .when(F.upper(t) == "CEO", "")
        .otherwise(F.substring_index(t, "/", 1))
    )
    slug = F.regexp_replace(F.regexp_replace(F.upper(segment), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", default).otherwise(slug)


def actor_slug(c: Column, default: str = "unknown", presence: str = "presence@") -> Column:
    """Lower-case actor without a random hex suffix."""
    t = strip(F.coalesce(c, F.lit("")))
    name = F.when(t.contains("/"), F.regexp_replace(t, "^[^/]*/", "")).otherwise(t)
    base = F.regexp_replace(F.lower(name), r"-[0-9a-f]{4,}$", "")
    slug = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return (
        F.when(t == "", default).when(F.lower(t).startswith(presence), "system")
        .when(F.upper(t) == "CEO", "operator").when(slug == "", default).otherwise(slug)
    )


def feed_findings(rows: DataFrame, default_project: str = "GENERAL", every: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of feed rows (line_no, ty, s, t, p, h): explicit kinds or ``Finding:`` markers.

    Rows that are no memory candidate are left out, or with ``every`` have no statement.  ``keep`` names columns to carry on.
    """
    p = F.col("p")
    kind = F.replace(strip(F.coalesce("ty", F.lit(""))), F.lit("-"), F.lit("_"))
    explicit = kind.isin("finding", "decision", "decision_point")
    label = F.lower(F.concat(F.regexp_extract(p, fixed.FEED_MARKER, 1), F.regexp_extract(p, fixed.FEED_MARKER, 2)))
    marked = p.rlike(fixed.FEED_MARKER)
    statement = F.when(marked, strip(F.regexp_extract(p, fixed.FEED_MARKER, 3))).when(explicit, strip(p))
    subkind = F.when(marked, F.when(label.contains("decision"), "decision").otherwise("outcome")).otherwise(
        F.when(kind == "finding", "outcome").otherwise("decision")
    )
    ts = D.feed_timestamp(F.coalesce(F.col("t"), F.lit("")))
    project = project_slug(F.col("s"), default_project)
    session = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.nullif(strip(F.col("h")), F.lit("")), F.concat(F.lit("feed-line-"), F.col("line_no").cast("string")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return rows.select(
        *keep, "line_no", statement.alias("statement"), subkind.alias("subkind"),
        F.lit("producer_asserted").alias("evidence_kind"), F.lit("bounded_support").alias("claim_status"),
        F.lit("traceable_unchecked").alias("freshness"), F.concat(F.lit("feed:"), F.col("line_no").cast("string")).alias("evidence_ref"),
        F.struct(
            project.alias("project"), actor_slug(F.col("s")).alias("actor"), session.alias("session"),
            F.col("line_no").alias("source_event_seq"), ts.alias("ts"),
        ).alias("provenance"),
        F.struct(ts.alias("valid_from"), F.lit(None).cast("double").alias("valid_to"), ts.alias("observed_at")).alias("validity"),
        F.lit("active").alias("lifecycle"),
    ).where(F.lit(True) if every else F.col("statement") != "")


def feed_verdicts(lines: DataFrame, default_project: str = "GENERAL", strict: bool = False) -> DataFrame:
    """Every feed line with what became of it: the columns of a finding, ``status``, ``reason`` and ``violations``.

    ``lines`` has line_no, value and problem.  A line is ``rejected`` for a problem of its form, for a rejection at
    the gate or, if ``strict``, for a breach of the write contract; ``skipped`` if it is no memory candidate; else ``admitted``.
    Breaches are told in ``violations`` in either case.
    """
    # a broken line may still parse in part
    parsed = F.when(F.col("problem").isNull(), F.from_json("value", schemas.FEED))
    rows = lines.select("line_no", "problem", parsed.alias("r")).select("line_no", "problem", "r.*")
    found = admit(feed_findings(rows, default_project, every=True, keep=("problem", "s", "t")))
    wrote = found.select("*", F.col("statement").alias("content"), F.col("s").alias("project"), F.col("s").alias("actor"), F.col("t").alias("timestamp"), F.array().cast("array<string>").alias("entities"))
    # a feed routes by project itself, so a producer need not name one
    both = inspect_writes(wrote, need_project=False)
    candidate = F.coalesce(F.col("statement") != "", F.lit(False))
    breach = candidate & (F.size("violations") > 0)
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(breach & F.lit(strict), F.concat(F.lit("write contract: "), F.array_join("violations", "; ")))
        .when(candidate, F.col("rejection"))
    )
    status = F.when(reason.isNotNull(), "rejected").when(candidate, "admitted").otherwise("skipped")
    shown = [c for c in found.columns if c not in ("problem", "s", "t", "rejection")]
    return both.select(
        *shown, "producer", F.when(candidate & F.col("problem").isNull(), F.col("violations")).otherwise(F.array().cast("array<string>")).alias("violations"),
        status.alias("status"), reason.alias("reason"),
    )


def norm_axis(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), "_", "-")


def admit(findings: DataFrame) -> DataFrame:
    """Add ``rejection``: falsified evidence may not enter as reference-validated."""
    bad = (norm_axis(F.col("evidence_kind")) == "falsified") & (norm_axis(F.col("claim_status")) == "reference-validated")
    return findings.withColumn("rejection", F.when(bad, "falsified evidence marked reference-validated"))


def finding_path(subkind: Column, statement: Column) -> Column:
    """Idempotent file name of a finding: kind and digest of the statement."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(subkind), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.concat(F.when(slug == "", "finding").otherwise(slug), F.lit("-"), F.substring(F.sha2(statement, 256), 1, 16), F.lit(".md"))


# ---- write contract -----------------------------------------------------------------------------------


def inspect_writes(
    writes: DataFrame, min_chars: int = 15, need_entities: bool = False, strict: bool = False,
    known_projects: list[str] | None = None, need_project: bool = True,
) -> DataFrame:
    """Add producer, violations and disposition to (content, project, actor, timestamp, entities)."""
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    content = text("content")
    failed = F.length(content) < min_chars
    known = F.lit(True) if not known_projects else project_slug(F.col("project")).isin(known_projects)
    violations = F.array_compact(
        F.array(
            F.when(content == "", "missing_content").when(failed, "content_too_short"),
            F.when(F.lit(need_project) & (text("project") == ""), "missing_project").when(~known, "uncontrolled_project"),
            F.when(text("actor") == "", "missing_actor"),
            F.when(D.feed_timestamp(text("timestamp")) <= 0, "missing_timestamp"),
            F.when(
                F.lit(need_entities) & ~F.exists(F.coalesce("entities", F.array().cast("array<string>")), lambda e: strip(e) != ""),
                "missing_entities",
            ),
        )
    )
    disposition = (
        F.when(F.size("violations") == 0, "accepted").when(failed | F.lit(strict), "rejected").otherwise("quarantined")
    )
    return writes.withColumn("violations", violations).withColumn("disposition", disposition).withColumn(
        "producer", F.concat_ws("/", project_slug(F.col("project")), actor_slug(F.col("actor")))
    )


def producer_tally(inspected: DataFrame) -> DataFrame:
    """Counts per producer, worst first by (not accepted, total)."""
    n = lambda s: F.count_if(F.col("disposition") == s).alias(s)
    per = inspected.groupBy("producer").agg(F.count("*").alias("total"), n("accepted"), n("quarantined"), n("rejected"))
    return per.withColumn("conformance", F.round(F.col("accepted") / F.col("total"), 4))


def violation_counts(inspected: DataFrame) -> DataFrame:
    return inspected.select("producer", F.explode("violations").alias("violation")).groupBy("producer", "violation").agg(
        F.count("*").alias("n")
    )


# ---- recall ledger ---------------------------------------------------------------------------------------


def merge_ledger(rows: DataFrame) -> DataFrame:
    """Queries with their latest known outcome; ``rows`` has pos and both row kinds.

    Usage and correctness are merged on their own: a later row without a label changes nothing.
    """
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("pos", c)))[c].alias(c)
    outcomes = rows.where("kind = 'outcome' and event_id is not null").groupBy("event_id").agg(
        last("was_used"), last("was_correct")
    )
    queries = rows.where("kind = 'query' and event_id is not null").drop("was_used", "was_correct", "kind")
    return queries.join(outcomes, "event_id", "left")


def latest_for(rows: DataFrame, by_agent: bool = False) -> DataFrame:
    """Latest event per query text (and agent)."""
    keys = ["query", "by"] if by_agent else ["query"]
    return rows.where("kind = 'query'").groupBy(*keys).agg(F.max(F.struct("pos", "event_id"))["event_id"].alias("event_id"))


def fleet_score(queries: DataFrame) -> DataFrame:
    """One row of usage and correctness over recorded queries."""
    found = F.coalesce("found", F.lit(False))
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    per_agent = queries.groupBy("by").agg(
        F.count("*").alias("queries"), count(found).alias("answered"),
        count(found & F.col("was_used").isNotNull()).alias("usage_labelled"),
        count(found & F.coalesce("was_used", F.lit(False))).alias("used"),
        count(found & F.col("was_correct").isNotNull()).alias("correctness_labelled"),
        count(found & F.coalesce("was_correct", F.lit(False))).alias("correct"),
        count(found & F.coalesce("abstained", F.lit(False))).alias("contradictions"),
    )
    total = per_agent.agg(
        F.count("*").alias("agents"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_agent.columns if c != "by"],
    )
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    return total.select(
        "queries", "agents", (F.col("agents") >= 2).alias("fleet_fed"), "answered", rate("answered", "queries").alias("answered_rate"),
        "usage_labelled", rate("used", "usage_labelled").alias("usage_rate"), "correctness_labelled",
        rate("correct", "correctness_labelled").alias("fleet_accuracy"), "contradictions", (F.col("queries") > 0).alias("measured"),
    )


def outcome_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(found, str_array(fixed.OUTCOME_STOPWORDS))


def _echoed(texts: pa.Table, recalled: pa.Table, ttl: float, share: float) -> np.ndarray:
    """Whether a text within ``ttl`` after a recall holds ``share`` of its tokens, for each recall."""
    out = np.zeros(recalled.num_rows, bool)
    texts = texts.sort_by("ts")
    n = texts.num_rows
    if not n or not len(out):
        return out
    # equal memories are compared once
    words = pa.array(["\x01".join(sorted(t)) for t in recalled.column("tokens").to_pylist()]).dictionary_encode()
    which = words.indices.to_numpy(zero_copy_only=False)
    sets = pa.table({"tokens": pa.array([w.split("\x01") for w in words.dictionary.to_pylist()], pa.list_(pa.string()))})
    written, said = texts.column("ts").to_numpy(), recalled.column("ts").to_numpy()
    first = np.searchsorted(written, said)
    size = pc.list_value_length(sets.column("tokens")).to_numpy()
    part = postings(texts, sets, "tokens")
    step = max(1, CELLS // n)
    for low in range(0, sets.num_rows, step):
        high = min(low + step, sets.num_rows)
        echo = shared_keys(part, low, high, n) / size[low:high, None] >= share
        # the time of the next echo from each text on
        after = np.minimum.accumulate(np.where(echo, written, np.inf)[:, ::-1], axis=1)[:, ::-1]
        here = np.flatnonzero((which >= low) & (which < high) & (first < n))
        out[here] = after[which[here] - low, first[here]] - said[here] <= ttl
    return out


def match_outcomes(
    recalls: DataFrame, writes: DataFrame, ttl: float = 1800.0, share: float = 0.6, least: int = 4
) -> DataFrame:
    """(event_id, was_used): a recall counts as used when a later text echoes one of its memories.

    ``recalls`` has event_id, agent, ts (seconds) and memories (array); ``writes`` write_id, agent,
    ts, text.  The text must come from the same agent within ``ttl`` seconds and hold ``share`` of
    the tokens of a memory with at least ``least`` tokens.  Both sides meet on agent and time slice; a task finds
    the next echo of each different memory in an array, so no pair of a recall and a text is a row.
    """
    memories = recalls.select("event_id", "agent", "ts", F.explode("memories").alias("memory")).withColumn(
        "tokens", outcome_tokens(F.col("memory"))
    ).where(F.size("tokens") >= least).drop("memory")
    slice_ = F.floor(F.col("ts") / ttl)
    meets = F.col("agent").isNotNull() & F.col("ts").isNotNull()
    asked = memories.where(meets).select("*", F.explode(F.array(slice_, slice_ + 1)).alias("slice"))
    asked = asked.withColumn("ts", F.col("ts").cast("double"))
    held = writes.where(meets).select(
        "write_id", "agent", F.col("ts").cast("double").alias("ts"), outcome_tokens(F.col("text")).alias("tokens"), slice_.alias("slice")
    )
    left, right, keys = in_blocks(held, asked, ["agent", "slice"], "write_id", "event_id")

    def run(texts: pa.Table, recalled: pa.Table) -> pa.Table:
        return recalled.select(["event_id"]).filter(pa.array(_echoed(texts, recalled, ttl, share), pa.bool_()))

    schema = StructType([StructField("event_id", recalls.schema["event_id"].dataType)])
    echoed = growing(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema).distinct())
    tracked = memories.select("event_id").distinct()
    return tracked.join(echoed.withColumn("hit", F.lit(True)), "event_id", "left").select(
        "event_id", F.coalesce("hit", F.lit(False)).alias("was_used")
    )


# ---- calibration --------------------------------------------------------------------------------------------


def score_table(examples: DataFrame) -> DataFrame:
    """(score, n_above, wrong_above): examples at least as strong as each score."""
    per = examples.groupBy("score").agg(F.count("*").alias("n"), F.count_if(~F.col("was_correct")).alias("wrong"))
    return running_sums(per, [], [F.desc("score")], {"n_above": F.col("n"), "wrong_above": F.col("wrong")})


def fit_gate(examples: DataFrame, target_error: float = 0.1, min_labelled: int = 30) -> DataFrame:
    """One row (threshold, n_labelled, n_accepted): lowest score whose error stays under the target.

    NULL below ``min_labelled`` examples; the highest score when no threshold meets the target.
    """
    table = score_table(examples)
    ok = F.col("wrong_above") / F.col("n_above") <= target_error
    one = table.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_labelled"), F.min(F.when(ok, F.col("score"))).alias("good"),
        F.max("score").alias("top"),
    )
    picked = one.select(
        "n_labelled", F.when(F.col("n_labelled") >= min_labelled, F.coalesce("good", "top")).alias("threshold")
    )
    return picked.join(
        table.select(F.col("score").alias("threshold"), F.col("n_above").alias("n_accepted")), "threshold", "left"
    ).select("threshold", "n_labelled", F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"))


def estimate_correctness(examples: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, score, estimate, n_neighbours) from the examples at least as strong as each score.

    A score beyond all examples is estimated as 1.0.  Examples and scores are ordered together, so
    each score reads its totals off the running sums.
    """
    per = examples.groupBy("score").agg(F.count("*").alias("n"), F.count_if("was_correct").alias("c"))
    mixed = per.select("score", "n", "c", F.lit(0).alias("asked"), F.lit(None).cast(scores.schema["id"].dataType).alias("id")).unionByName(
        scores.select("score", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.lit(1).alias("asked"), "id")
    )
    sums = running_sums(mixed, [], [F.desc("score"), F.asc("asked"), F.asc("id")], {"n_above": F.col("n"), "c_above": F.col("c")})
    any_ = examples.agg(F.count("*")).scalar()
    estimate = F.when(F.col("n_above") > 0, F.col("c_above") / F.col("n_above")).when(any_ > 0, 1.0).otherwise(0.0)
    return sums.where("asked = 1").select("id", "score", estimate.alias("estimate"), F.col("n_above").alias("n_neighbours"))


def decide(estimates: DataFrame, gate: DataFrame) -> DataFrame:
    """Add abstain and reason to estimated scores; a missing score abstains."""
    threshold = gate.select("threshold").scalar()
    s = F.col("score")
    reason = (
        F.when(s.isNull(), "no_score").when(threshold.isNull(), "insufficient_labels")
        .when(s < threshold, "score_below_threshold").otherwise("accepted")
    )
    return estimates.withColumn("reason", reason).withColumn("abstain", F.col("reason") != "accepted")


def split_holdout(examples: DataFrame, fraction: float = 0.25, tie: str = "id") -> DataFrame:
    """Add ``holdout``: the strongest example and the weakest ones, about ``fraction`` of all."""
    placed = row_index(examples, [], [F.desc("score"), F.asc(tie)])
    n = examples.agg(F.count("*")).scalar()
    size = F.least(F.greatest(F.lit(1), F.bround(n * fraction).cast("long")), n - 1)
    hold = F.lit(fraction > 0) & (size > 0) & ((F.col("pos") == 1) | (F.col("pos") > n - (size - 1)))
    return placed.withColumn("holdout", hold).drop("pos")


def holdout_report(decided: DataFrame) -> DataFrame:
    """One row of coverage and calibration over decided examples (was_correct, estimate, abstain)."""
    taken = ~F.col("abstain")
    one = decided.agg(
        F.count("*").alias("n_total"), F.count_if(taken).alias("n_accepted"),
        F.avg(F.when(taken, F.col("was_correct").cast("double"))).alias("accuracy"),
        F.avg(F.when(taken, F.col("estimate"))).alias("mean_estimate"),
    )
    return one.select(
        "n_total", "n_accepted", (F.col("n_total") - F.col("n_accepted")).alias("n_abstained"),
        F.when(F.col("n_total") > 0, F.col("n_accepted") / F.col("n_total")).otherwise(0.0).alias("coverage"),
        "accuracy", "mean_estimate", F.abs(F.col("accuracy") - F.col("mean_estimate")).alias("calibration_error"),
        (1.0 - F.col("accuracy")).alias("error_rate"),
    )


# ---- freshness and resume -----------------------------------------------------------------------------------


def pipeline_freshness(artifacts: DataFrame, max_drift_days: float = 7.0) -> DataFrame:
    """One row of drift from the first to the last stage that has artifacts.

    ``artifacts`` has stage_pos and modified; a source without any later stage is stale.
    """
    per = artifacts.groupBy("stage_pos").agg(F.max("modified").alias("newest"), F.count("*").alias("n"))
    ends = per.agg(
        F.min_by("newest", "stage_pos").alias("source"), F.max_by("newest", "stage_pos").alias("sink"),
        F.count("*").alias("stages"), F.sum("n").alias("artifacts"),
    )
    drift = F.when(F.col("stages") > 1, (F.unix_micros("source") - F.unix_micros("sink")) / 1e6)
    stale = ((F.col("stages") == 1) | (drift > max_drift_days * 86400)) & (F.col("stages") > 0)
    return ends.select("stages", "artifacts", drift.alias("drift_seconds"), F.coalesce(stale, F.lit(False)).alias("stale"))


def remaining(items: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """Items that have no finished record yet."""
    return items.join(done.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_k")).distinct(),
                      items[key].cast("string") == F.col("_k"), "left_anti")

