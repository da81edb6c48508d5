"""Score, band and reason expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import percent

# Weights, scores and thresholds of the risk fusion.
WEIGHT_BEHAVIOUR, WEIGHT_TEXT = 0.55, 0.45
TEXT_SCORE = {"High": 0.9, "Medium": 0.55, "Low": 0.15}
BAND_FLOORS = [("Critical", 0.75), ("High", 0.55), ("Medium", 0.35)]
AT_RISK = 0.55
LEAVING_FLOOR = 0.85
CONFIDENCE_FLOOR = 0.5
NEUTRAL_PRIOR = 0.5
MAX_REASONS = 5

NO_PROFILE = "no stored profile: judged on the message alone"
STATES_LEAVING = "says they are leaving the country"
HIGH_INTENT = "wording shows strong intent to leave"


def rule_tests() -> list[tuple[str, str, Column]]:
    """(feature, chart label, test) of the seven behaviour rules, in reporting order."""
    c = F.col
    return [
        ("balance_trend_3m", "Falling balance", c("balance_trend_3m") < -0.15),
        ("salary_credit_active", "Salary not credited",
         c("salary_credit_active").cast("int") == 0),
        ("intl_transfer_spike", "Foreign transfers spiking",
         c("intl_transfer_spike").cast("int") == 1),
        ("complaints_6m", "Repeated complaints", c("complaints_6m") >= 3),
        ("branch_visits_trend", "Fewer branch visits", c("branch_visits_trend") < -0.4),
        ("tenure_months", "Recent customer", c("tenure_months") <= 12),
        ("remittance_count_3m", "Frequent remittances", c("remittance_count_3m") >= 8),
    ]


def _reason_text(feature: str) -> Column:
    value = F.col(feature)
    count = value.cast("string")
    return {
        "balance_trend_3m": F.concat(F.lit("balance moved "), percent(value),
                                     F.lit(" in three months")),
        "salary_credit_active": F.lit("salary no longer arrives"),
        "intl_transfer_spike": F.lit("unusual foreign transfers"),
        "complaints_6m": F.concat(count, F.lit(" complaints in half a year")),
        "branch_visits_trend": F.lit("branch visits dropping fast"),
        "tenure_months": F.concat(F.lit("customer for only "), count, F.lit(" months")),
        "remittance_count_3m": F.concat(count, F.lit(" remittances in three months")),
    }[feature]


def behaviour_reasons() -> Column:
    return F.array_compact(F.array(*[F.when(test, _reason_text(feature))
                                     for feature, _, test in rule_tests()]))


def band(risk: Column) -> Column:
    """Band of the *unrounded* risk."""
    (first, floor), *rest = BAND_FLOORS
    chain = F.when(risk >= floor, first)
    for name, low in rest:
        chain = chain.when(risk >= low, name)
    return chain.otherwise("Low")


def text_score(signal: Column) -> Column:
    chain = None
    for name, score in TEXT_SCORE.items():
        chain = (F if chain is None else chain).when(signal == name, F.lit(score))
    return chain


def mix(behaviour: Column, text: Column) -> Column:
    return WEIGHT_BEHAVIOUR * behaviour + WEIGHT_TEXT * text


def with_leaving_floor(risk: Column, leaving: Column) -> Column:
    return F.when(leaving, F.greatest(risk, F.lit(LEAVING_FLOOR))).otherwise(risk)


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "strong").when(confidence >= 0.5, "fair").otherwise("weak")


# What a reviewer should look at, as (code, test) in display order.
def review_checks() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("read_original", c("needs_human_triage")),
        ("verify_relocation", c("leaving_confirmed")),
        ("calm_behaviour_alarming_text",
         (c("behaviour_score") < 0.35) & (c("text_score") >= 0.9)),
        ("quiet_high_risk", (c("behaviour_score") >= 0.75) & (c("text_score") <= 0.2)),
        ("high_value", c("clv_estimate_aed") >= 100000),
    ]


def reviewer_checklist() -> Column:
    found = F.array_compact(F.array(*[F.when(test, code) for code, test in review_checks()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("nothing_unusual")))


