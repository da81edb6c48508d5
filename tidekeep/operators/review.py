"""Human verdicts: log rows, transitions, current status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DECISION_FIELDS, PENDING, VERDICTS
from .decide import ACTION_LABELS
from .literal import lookup


def text_or(*options: Column | str) -> Column:
    """First option that is neither null nor empty."""
    cols = [F.col(o) if isinstance(o, str) else o for o in options]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def log_order() -> Column:
    """Append order: time, then sequence (files have no order of their own)."""
    return F.struct("timestamp", "seq")


def reviewed(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("human_verdict").isNotNull() & (F.col("human_verdict") != ""))


def latest_status(audit: DataFrame) -> DataFrame:
    """Last verdict per message. Partial aggregation collapses hot messages before the shuffle."""
    return reviewed(audit).groupBy("message_id").agg(
        F.max_by("human_verdict", log_order()).alias("status"))


def first_verdict(audit: DataFrame) -> DataFrame:
    """First *decided* verdict per message; later ones are ignored."""
    decided = reviewed(audit).filter(F.col("human_verdict").isin(*VERDICTS))
    return decided.groupBy("message_id").agg(F.min_by(
        F.struct("human_verdict", "reviewer_note", "timestamp", "seq"), log_order())
        .alias("_first")).select("message_id", "_first.*")


def with_status(queue: DataFrame, status: DataFrame) -> DataFrame:
    return queue.join(status, "message_id", "left").withColumn(
        "status", F.coalesce("status", F.lit(PENDING)))


def apply_review(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cases joined to verdicts (``human_verdict``, ``reviewer_note``, optional
    ``override_action`` and ``edited_message``).

    An override replaces action and label and deliberately keeps the old offer.
    """
    return reviewed_cases(with_verdicts(cases, verdicts), cases.columns)


VERDICT_FIELDS = ["human_verdict", "reviewer_note", "override_action", "edited_message"]


def with_verdicts(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The cases that have a verdict, with it; drafts may be made after this join, for them only."""
    wanted = ["message_id", *VERDICT_FIELDS]
    filled = verdicts.select(*[
        F.col(c) if c in verdicts.columns else F.lit(None).cast("string").alias(c)
        for c in wanted])
    return cases.join(filled, "message_id")


def reviewed_cases(joined: DataFrame, columns: list[str]) -> DataFrame:
    """What the verdict makes of each joined case; ``columns`` are those of the cases."""
    verdict, override = F.col("human_verdict"), F.col("override_action")
    action = (F.when((verdict == "Overridden") & (F.coalesce(override, F.lit("")) != ""), override)
              .when(verdict == "Dignified Goodbye", "dignified_goodbye")
              .otherwise(F.col("action")))
    final = F.when(verdict == "Rejected", "").otherwise(text_or("edited_message",
                                                                "draft_message"))
    out = joined.withColumns({"action": action, "final_message": final,
                              "reviewer_note": F.coalesce("reviewer_note", F.lit(""))})
    return out.withColumns({
        "action_label": F.coalesce(lookup(F.col("action"), ACTION_LABELS), F.col("action")),
        "status": verdict}).select(
        *columns, "human_verdict", "reviewer_note", "final_message",
        *([] if "status" in columns else ["status"]))


def decision_rows(reviewed_cases: DataFrame, timestamp: Column) -> DataFrame:
    """The 16 logged fields of a reviewed case."""
    return reviewed_cases.withColumn("timestamp", timestamp).select(*DECISION_FIELDS)


def audit_view(audit: DataFrame) -> DataFrame:
    """Display projection over both row kinds; sort by ``newest_first``."""
    blank = F.lit("")
    composed = F.concat(
        F.coalesce("issue_type", blank), F.lit(" "), F.coalesce("churn_signal", blank),
        F.lit(" -> "), F.coalesce("risk_band", blank), F.lit(" -> "), F.coalesce("action", blank))
    verdict = F.coalesce("human_verdict", blank)
    return audit.select(
        "seq", F.coalesce("timestamp", blank).alias("timestamp"),
        F.coalesce("type", F.lit("decision")).alias("type"),
        text_or("actor", verdict).alias("actor_or_verdict"),
        F.coalesce("customer_id", blank).alias("customer"),
        text_or("summary", composed).alias("summary"),
        text_or("status", verdict).alias("status"))


COMPACT_FIELDS = ["timestamp", "customer_id", "language", "issue_type", "risk_band", "action",
                  "offer_value_aed", "draft_source", "human_verdict"]


def compact_view(audit: DataFrame) -> DataFrame:
    return audit.select("seq", *COMPACT_FIELDS)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("timestamp").desc(), F.col("seq").desc())


def review_stats(audit: DataFrame, profile: DataFrame) -> DataFrame:
    """Reviewed rows with the customer's segment."""
    segments = profile.select("customer_id", "segment")
    return reviewed(audit).join(segments, "customer_id", "left").withColumn(
        "segment", F.coalesce("segment", F.lit("Unknown")))
