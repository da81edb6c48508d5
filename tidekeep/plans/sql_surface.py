"""The engine from SQL: functions without Python behind them, and views over the transforms.

``register`` gives a session the functions ``keyword_issue``, ``churn_intent``, ``says_leaving``,
``behaviour_mix``, ``risk_band`` and ``decision_rule``, all SQL expressions that the optimiser
inlines, and the views ``inbox``, ``book``, ``signals``, ``risk``, ``decisions`` and ``queue``. A
query names the columns it wants; only those are computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import risk as rk
from ..lexicon import DEFAULT, Lexicon
from ..operators import decide as dc
from ..operators.assess import Scorer, assess, score_book
from ..operators.decide import decide
from ..operators.listen import listen_declared
from .queue import build_queue


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(phrases) -> str:
    return "(" + " OR ".join(f"contains(lower(message), {_text(p.lower())})" for p in phrases) + ")"


def functions(lex: Lexicon = DEFAULT) -> dict[str, str]:
    """Signature and body of every function."""
    issues = " ".join(f"WHEN {_any(words)} THEN {_text(name)}" for name, words in lex.issues)
    bands = " ".join(f"WHEN risk >= {floor}D THEN {_text(name)}" for name, floor in rk.BAND_FLOORS)
    scores = " ".join(f"WHEN {_text(k)} THEN {v}D" for k, v in rk.TEXT_SCORE.items())
    mixed = (f"{rk.WEIGHT_BEHAVIOUR}D * coalesce(behaviour, {rk.NEUTRAL_PRIOR}D)"
             f" + {rk.WEIGHT_TEXT}D * CASE signal {scores} END")
    cap = f"{dc.OFFER_CAP}D * clv"
    return {
        "keyword_issue(message STRING) RETURNS STRING":
            f"CASE {issues} ELSE {_text(lex.fallback_issue)} END",
        "says_leaving(message STRING) RETURNS BOOLEAN": _any(lex.leaving),
        "churn_intent(message STRING) RETURNS STRING":
            f"CASE WHEN {_any(lex.leaving)} THEN 'High' WHEN {_any(lex.wavering)} THEN 'Medium'"
            " ELSE 'Low' END",
        "behaviour_mix(behaviour DOUBLE, signal STRING, leaving BOOLEAN) RETURNS DOUBLE":
            f"CASE WHEN leaving THEN greatest({mixed}, {rk.LEAVING_FLOOR}D) ELSE {mixed} END",
        "risk_band(risk DOUBLE) RETURNS STRING": f"CASE {bands} ELSE 'Low' END",
        "decision_rule(uncertain BOOLEAN, leaving BOOLEAN, band STRING, issue STRING,"
        " segment STRING, clv DOUBLE) RETURNS STRING":
            f"""CASE WHEN uncertain THEN '0' WHEN leaving THEN '1'
WHEN band IN ('Critical', 'High') THEN CASE
  WHEN issue = 'Fees_Charges' THEN if({dc.FEE_WAIVER}D <= {cap}, '2a', '2a\\'')
  WHEN issue = 'Remittance_Transfer' THEN if({dc.REMITTANCE_DISCOUNT}D <= {cap}, '2b', '2b\\'')
  WHEN issue = 'Loan_Mortgage' THEN '2c' WHEN segment IN ('Premium', 'Private') THEN '2d'
  ELSE '2e' END
WHEN issue IN ('App_Technical', 'Card_Services') THEN '3' WHEN band = 'Medium' THEN '4'
ELSE '5' END""",
    }


def register(spark: SparkSession, messages: DataFrame, profile: DataFrame,
             scorer: Scorer | None = None, lex: Lexicon = DEFAULT, classify=None) -> list[str]:
    """Create functions and views for this session; returns the names of the views."""
    for signature, body in functions(lex).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    signals = listen_declared(messages, lex, classify)
    risk = assess(signals, profile, scorer)
    views = {"inbox": messages, "book": score_book(profile, scorer), "signals": signals,
             "risk": risk, "decisions": decide(risk),
             "queue": build_queue(messages, profile, scorer, lex, classify)}
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return list(views)
