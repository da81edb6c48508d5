"""Named situations, each a real message paired with a real customer picked by criteria."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    name: str
    message: dict[str, str] = field(default_factory=dict)  # column -> value
    contains: str | None = None
    customer: str = "true"  # SQL predicate over the profile


# The six picks.
SCENARIOS = [
    Scenario("premium_leaver", {"language": "en", "issue_type": "Account_Closure",
                                "churn_signal": "High"}, "salary account",
             "segment = 'Premium' AND churned AND NOT salary_credit_active"),
    Scenario("funds_abroad", {"language": "ar", "issue_type": "Remittance_Transfer",
                              "churn_signal": "High"}, None, "intl_transfer_spike AND churned"),
    Scenario("fee_complaint", {"issue_type": "Fees_Charges", "churn_signal": "Medium"}, None,
             "segment = 'Mass' AND complaints_6m >= 3 AND NOT churned"),
    Scenario("app_failure", {"issue_type": "App_Technical", "churn_signal": "Medium"}, None,
             "complaints_6m >= 4 AND NOT churned"),
    Scenario("routine_query", {"issue_type": "General_Query", "churn_signal": "Low"}, None,
             "segment = 'Private' AND NOT churned AND salary_credit_active"),
    Scenario("confirmed_leaver", {"language": "tl", "churn_signal": "High"}, None,
             "churned AND NOT salary_credit_active"),
]


def matches(criteria: dict[str, str], contains: str | None = None) -> Column:
    """Equality per column plus a case-insensitive literal search."""
    test = F.lit(True)
    for column, value in criteria.items():
        test = test & (F.col(column) == value)
    if contains:
        test = test & F.contains(F.lower("text"), F.lit(contains.lower()))
    return test


def first_matches(df: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """(scenario, key) of the first match of each test in key order, or the first row of all.

    All picks are minima of one aggregation: one scan, no sort, one row out.
    """
    picks = df.agg(F.min(key).alias("_first"),
                   *[F.min(F.when(t, F.col(key))).alias(n) for n, t in tests.items()])
    return picks.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.coalesce(n, "_first").alias(key))
        for n in tests])))


def pick_messages(messages: DataFrame, specs: list[Scenario] = SCENARIOS) -> DataFrame:
    return first_matches(messages, "message_id",
                         {s.name: matches(s.message, s.contains) for s in specs})


def pick_customers(profile: DataFrame, specs: list[Scenario] = SCENARIOS) -> DataFrame:
    return first_matches(profile, "customer_id", {s.name: F.expr(s.customer) for s in specs})


def build_scenarios(messages: DataFrame, profile: DataFrame,
                    specs: list[Scenario] = SCENARIOS) -> DataFrame:
    """One row per scenario. The two picks are joined on the scenario name, and the message text
    is fetched for the few picked ids (one per scenario, so the hint is bounded)."""
    chosen = pick_messages(messages, specs).join(pick_customers(profile, specs), "scenario")
    details = messages.select("message_id", "text", "language")
    return details.join(F.broadcast(chosen), "message_id").select(
        "scenario", "message_id", "text", "language", "customer_id")
