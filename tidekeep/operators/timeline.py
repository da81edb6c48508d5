"""Step-by-step record of how a case was handled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent
from .decide import ACTION_LABELS
from .literal import lookup

# Step names in processing order.
STEPS = ["Message received", "Language detected", "Issue classified", "Churn signal detected",
         "Entities extracted", "Behaviour model scored", "Fused risk calculated",
         "Action recommended", "Outreach drafted"]
REVIEW_STEPS = ["Human reviewed", "Final decision logged"]


def _entity_text() -> Column:
    entities = F.col("entities")
    parts = []
    for name in ("amounts_aed", "dates", "destinations", "products"):
        values = F.transform(entities[name], lambda v: v.cast("string"))
        parts.append(F.when(entities[name].isNotNull(), F.concat(
            F.lit(f"{name}: "), F.array_join(values, ", "))))
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", "none").otherwise(joined)


def case_steps(with_draft: bool) -> Column:
    c, none = F.col, F.lit(None).cast("double")
    rows = [
        (F.concat(c("text_length").cast("string"), F.lit(" chars, customer "), c("customer_id")),
         none),
        (c("language"), c("language_confidence")),
        (F.concat(c("issue_type"), F.lit(" (model: "), c("classifier"), F.lit(")")),
         c("issue_confidence")),
        (c("churn_signal"), c("churn_signal_confidence")),
        (_entity_text(), none),
        (F.concat(F.lit("P(churn) = "), percent(c("behaviour_score")),
                  F.when(c("profile_found"), "").otherwise(" (no profile, neutral prior)")), none),
        (F.concat(percent(c("fused_risk")), F.lit(" -> "), c("risk_band")), none),
        (lookup(c("action"), ACTION_LABELS), none),
    ]
    if with_draft:
        flags = F.size("guardrail_flags")
        rows.append((F.concat(
            F.when(c("draft_source") == "llm", "generated").otherwise("template"),
            F.lit(" in "), c("draft_language"),
            F.when(flags > 0, F.concat(F.lit(", flags: "), flags.cast("string"))).otherwise("")),
            none))
    return F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"),
                 F.lit("ai_system").alias("actor"), summary.alias("summary"),
                 conf.alias("conf"))
        for i, (name, (summary, conf)) in enumerate(zip(STEPS, rows))])


def case_timeline(cases: DataFrame) -> DataFrame:
    """One row per step: 8 per case, 9 when a draft was made. Map-only."""
    with_draft = "draft_message" in cases.columns
    if "text_length" not in cases.columns:
        cases = cases.withColumn("text_length", F.length("text"))
    return cases.select("message_id", F.inline(case_steps(with_draft)))


def review_timeline(log: DataFrame) -> DataFrame:
    """Rows that reviews, redrafts and edits append to a timeline.

    Verdict rows give two steps, event rows of the redraft and edit kinds one.
    """
    note = F.coalesce("reviewer_note", F.lit(""))
    verdict_steps = F.array(
        F.struct(F.lit(0).alias("part"), F.lit(REVIEW_STEPS[0]).alias("step"),
                 F.lit("human_reviewer").alias("actor"),
                 F.concat(F.col("human_verdict"),
                          F.when(note != "", F.concat(F.lit(' - "'), note, F.lit('"')))
                          .otherwise("")).alias("summary")),
        F.struct(F.lit(1).alias("part"), F.lit(REVIEW_STEPS[1]).alias("step"),
                 F.lit("ai_system").alias("actor"),
                 F.lit("appended to the audit log").alias("summary")))
    own_step = F.array(F.struct(F.lit(0).alias("part"), F.col("step").alias("step"),
                                F.col("actor").alias("actor"),
                                F.col("summary").alias("summary")))
    has_verdict = F.coalesce("human_verdict", F.lit("")) != ""
    return log.select("message_id", "timestamp", "seq",
                      F.inline(F.when(has_verdict, verdict_steps).otherwise(own_step)))


def extended_timeline(cases: DataFrame, log: DataFrame,
                      known: DataFrame | None = None) -> DataFrame:
    """Base steps followed by logged steps of the same cases, in one long table whose order is
    (message_id, timestamp nulls first, seq, part). ``known`` may name the cases (message_id), so
    that they are not worked out twice."""
    known = (cases if known is None else known).select("message_id").distinct()
    base = case_timeline(cases).select(
        "message_id", F.lit(None).cast("string").alias("timestamp"),
        F.lit(0).cast("bigint").alias("seq"), F.col("step_no").alias("part"), "step", "actor",
        "summary", "conf")
    later = review_timeline(log).join(known, "message_id", "left_semi").withColumn(
        "conf", F.lit(None).cast("double"))
    return base.unionByName(later)
