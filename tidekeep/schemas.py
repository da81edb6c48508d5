"""Column contracts. Nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Label vocabularies, in the order that decides ties and encodings.
ISSUES = ["Account_Closure", "Remittance_Transfer", "Loan_Mortgage", "Fees_Charges",
          "Card_Services", "App_Technical", "General_Query"]
SIGNALS = ["High", "Medium", "Low"]
LANGUAGES = ["en", "ar", "hi", "tl"]
SEGMENTS = ["Mass", "Premium", "Private"]
BANDS = ["Low", "Medium", "High", "Critical"]
VERDICTS = ["Approved", "Approved with edits", "Overridden", "Rejected", "Escalated",
            "Dignified Goodbye"]
PENDING = "Pending Review"
NO_CUSTOMER = "UNKNOWN"

# Column contracts.
NUMERIC = ["tenure_months", "products_held", "avg_balance_aed", "balance_trend_3m",
           "remittance_count_3m", "complaints_6m", "branch_visits_trend", "clv_estimate_aed"]
BOOLEAN = ["salary_credit_active", "intl_transfer_spike"]
CATEGORICAL = ["segment"]
FEATURES = NUMERIC + BOOLEAN + CATEGORICAL
AUDIT_ONLY = ["nationality_region"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

PROFILE = _struct(
    customer_id=_S, nationality_region=_S, tenure_months=_I, segment=_S, products_held=_I,
    avg_balance_aed=_D, balance_trend_3m=_D, salary_credit_active=_B, remittance_count_3m=_I,
    intl_transfer_spike=_B, complaints_6m=_I, branch_visits_trend=_D, clv_estimate_aed=_I,
    churned=_B)

MESSAGE = _struct(message_id=_S, customer_id=_S, text=_S, language=_S, issue_type=_S,
                  churn_signal=_S)

ENTITIES = _struct(amounts_aed=T.ArrayType(_D), dates=T.ArrayType(_S),
                   destinations=T.ArrayType(_S), products=T.ArrayType(_S))

DECISION_FIELDS = ["timestamp", "message_id", "customer_id", "language", "issue_type",
                   "churn_signal", "leaving_confirmed", "fused_risk", "risk_band", "action",
                   "offer_value_aed", "draft_source", "guardrail_flags", "human_verdict",
                   "reviewer_note", "final_message"]

# One nullable superset of the two row kinds (events and decisions) kept in the log.
AUDIT = _struct(
    timestamp=_S, type=_S, step=_S, actor=_S, summary=_S, status=_S, confidence=_D,
    message_id=_S, customer_id=_S, language=_S, issue_type=_S, churn_signal=_S,
    leaving_confirmed=_B, fused_risk=_D, risk_band=_S, action=_S, offer_value_aed=_D,
    draft_source=_S, guardrail_flags=T.ArrayType(_S), human_verdict=_S, reviewer_note=_S,
    final_message=_S, seq=T.LongType(), extras=T.MapType(_S, _S))
