"""Signals joined to scored profiles: fused, banded and explained risk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk as rk
from ..functions.numeric import round_exact
from ..schemas import AUDIT_ONLY, FEATURES, NO_CUSTOMER
from .skew import left_join

Scorer = Callable[[DataFrame], DataFrame]


def feature_frame(profile: DataFrame) -> DataFrame:
    """Key and model features only; audit-only columns cannot pass."""
    frame = profile.select("customer_id", *[
        F.col(c).cast("int").alias(c) if dict(profile.dtypes)[c] == "boolean" else F.col(c)
        for c in FEATURES])
    guard_features(frame.columns)
    return frame


def guard_features(columns: list[str]) -> None:
    leaked = sorted(set(columns) & set(AUDIT_ONLY))
    if leaked:
        raise ValueError(f"audit-only columns among the model inputs: {leaked}")


def fixed_scorer(profile: DataFrame, intercept: float, weights: dict[str, float],
                 output: str = "behaviour") -> DataFrame:
    """Logistic score with given coefficients, as one expression."""
    guard_features(list(weights))
    z = F.lit(intercept)
    for feature, weight in weights.items():
        z = z + weight * F.col(feature).cast("double")
    return profile.withColumn(output, 1.0 / (1.0 + F.exp(-z)))


def score_book(profile: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Every profile with ``behaviour_risk`` and its band; no model means the neutral prior."""
    scored = (scorer(profile) if scorer
              else profile.withColumn("behaviour", F.lit(rk.NEUTRAL_PRIOR)))
    return (scored.withColumnRenamed("behaviour", "behaviour_risk")
            .withColumn("band", rk.band(F.col("behaviour_risk"))))


def explained_book(profile: DataFrame, scorer: Scorer | None) -> DataFrame:
    """The profile columns risk needs. Scoring and explaining happen once per customer, before
    the join, not once per message after it."""
    reasons = (rk.behaviour_reasons() if scorer
               else F.array(F.lit(rk.NO_PROFILE)))
    return score_book(profile, scorer).select(
        "customer_id", F.col("behaviour_risk").alias("_behaviour"),
        reasons.alias("_reasons"), F.col("segment").alias("_segment"),
        F.col("clv_estimate_aed").cast("double").alias("_clv"), F.lit(True).alias("_found"))


def fuse(signals: DataFrame, profile: DataFrame, scorer: Scorer | None = None,
         hot_share: float | None = None, with_reasons: bool = True) -> DataFrame:
    """Signals joined to the book, with unrounded ``_mixed`` and ``_fused`` risk.

    The planner picks the join from measured sizes. ``hot_share`` turns on salting of customers
    above that share of the messages.
    """
    book = explained_book(profile, scorer)
    if not with_reasons:
        book = book.drop("_reasons")
    joined = left_join(signals, book, "customer_id", spread_by="message_id",
                       hot_share=hot_share, unmatched=F.col("customer_id") == NO_CUSTOMER)
    scored = joined.withColumns({
        "_behaviour": F.coalesce("_behaviour", F.lit(rk.NEUTRAL_PRIOR)),
        "text_score": rk.text_score(F.col("churn_signal"))})
    mixed = scored.withColumn("_mixed", rk.mix(F.col("_behaviour"), F.col("text_score")))
    return mixed.withColumn("_fused", rk.with_leaving_floor(F.col("_mixed"),
                                                            F.col("leaving_confirmed")))


def message_reasons():
    """Headline first, then the customer's rules, or the no-profile note; at most five."""
    headline = (F.when(F.col("leaving_confirmed"), F.array(F.lit(rk.STATES_LEAVING)))
                .when(F.col("churn_signal") == "High", F.array(F.lit(rk.HIGH_INTENT)))
                .otherwise(F.array().cast("array<string>")))
    known = F.coalesce("_reasons", F.array(F.lit(rk.NO_PROFILE)))
    return F.slice(F.concat(headline, known), 1, rk.MAX_REASONS)


def needs_triage(text_score):
    """A weak label, a label without a confidence, or a signal without a score is for a person."""
    return text_score.isNull() | F.coalesce(
        (F.col("issue_confidence") < rk.CONFIDENCE_FLOOR)
        | (F.col("churn_signal_confidence") < rk.CONFIDENCE_FLOOR), F.lit(True))


def assess(signals: DataFrame, profile: DataFrame, scorer: Scorer | None = None,
           hot_share: float | None = None, with_reasons: bool = True) -> DataFrame:
    """Signals plus the risk columns. Unmatched customers keep the neutral prior."""
    fused = fuse(signals, profile, scorer, hot_share, with_reasons)
    out = {
        "behaviour_score": round_exact(F.col("_behaviour"), 3),
        "text_score": F.col("text_score"),
        "fused_risk": round_exact(F.least("_fused", F.lit(1.0)), 3),
        "risk_band": rk.band(F.col("_fused")),
        "needs_human_triage": needs_triage(F.col("text_score")),
        "segment": F.coalesce("_segment", F.lit("Unknown")),
        "clv_estimate_aed": F.coalesce("_clv", F.lit(0.0)),
        "profile_found": F.col("_found").isNotNull(),
        "model_available": F.lit(scorer is not None),
    }
    if with_reasons:
        out["reasons"] = message_reasons()
    return fused.select(*signals.columns, *[e.alias(n) for n, e in out.items()])
