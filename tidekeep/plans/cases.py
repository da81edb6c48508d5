"""The full live path: listen, assess, decide, draft."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lexicon import DEFAULT, Lexicon
from ..operators.assess import Scorer, assess
from ..operators.decide import decide
from ..operators.listen import listen
from ..operators.outreach import serve, with_prompt
from ..schemas import PENDING


def run_cases(messages: DataFrame, profile: DataFrame, scorer: Scorer | None = None,
              lex: Lexicon = DEFAULT, classify=None, candidates: DataFrame | None = None,
              with_draft: bool = True, with_prompts: bool = False, tone: str | None = None,
              hot_share: float | None = None) -> DataFrame:
    """Every message with signals, risk, plan and (optionally) the draft to review.

    ``candidates`` (message_id, candidate) are texts of an external generator.
    """
    # The timeline reports the length of a text; taken here, no text needs to follow the joins.
    signals = listen(messages, lex, classify).withColumn("text_length", F.length("text"))
    risk = assess(signals, profile, scorer, hot_share=hot_share)
    plan = decide(risk)
    if with_prompts:
        plan = with_prompt(plan, tone)
    if not with_draft:
        return plan.withColumn("status", F.lit("Drafted"))
    served = serve(plan, lex, candidates)
    return served.withColumn("status", F.lit(PENDING))


def analysis_events(cases: DataFrame) -> DataFrame:
    """The one-line summary logged for each analysed case."""
    c = F.col
    return cases.select(
        F.lit("case_analyzed").alias("step"), F.lit("ai_system").alias("actor"),
        F.concat_ws(" ", "message_id", "issue_type", "churn_signal", F.lit("->"), "risk_band",
                    F.lit("->"), "action").alias("summary"),
        c("issue_confidence").alias("confidence"), "customer_id", "message_id")
