"""The review queue: every message scored, decided and ranked by fused risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import whole
from ..lexicon import DEFAULT, Lexicon
from ..operators.assess import Scorer, assess
from ..operators.decide import decide
from ..operators.key_filter import may_match
from ..operators.listen import listen_declared
from ..operators.ranking import rank_rows, top_rows
from ..session import written

QUEUE_COLUMNS = ["message_id", "customer_id", "lang", "issue", "signal", "fused_risk", "band",
                 "segment", "clv_aed", "recommended", "action", "offer"]
VIEW_COLUMNS = ["message_id", "customer_id", "lang", "issue", "signal", "fused_risk", "band",
                "segment", "clv_aed", "recommended", "status"]


def build_queue(messages: DataFrame, profile: DataFrame, scorer: Scorer | None = None,
                lex: Lexicon = DEFAULT, classify=None, hot_share: float | None = None,
                with_text: bool = False) -> DataFrame:
    """One linear plan: scan, label expressions, one join, risk and rule expressions.

    Texts are left out unless asked for: labels are computed where the text is scanned, and only
    the narrow signal columns go through the join. ``attach_text`` fetches texts of a page.
    """
    signals = listen_declared(messages, lex, classify)
    risk = assess(signals, profile, scorer, hot_share=hot_share, with_reasons=False)
    plan = decide(risk, with_rationale=False)
    c = F.col
    queue = plan.select(
        "message_id", "customer_id", c("language").alias("lang"), c("issue_type").alias("issue"),
        c("churn_signal").alias("signal"), "fused_risk", c("risk_band").alias("band"), "segment",
        c("clv_estimate_aed").alias("clv_aed"), c("action_label").alias("recommended"),
        "action", c("offer_value_aed").alias("offer"), *(["text"] if with_text else []))
    return queue


def ranked_queue(queue: DataFrame, write_first: bool = True) -> DataFrame:
    """Exact rank of every row (highest fused risk first), with no single-task window.

    The queue is read twice (cell sizes, then positions), so it is written once before.
    """
    source = written(queue, "queue") if write_first else queue
    return rank_rows(source, -F.rint(F.col("fused_risk") * 1000).cast("int"), "message_id",
                     output="rank")


def queue_page(queue: DataFrame, n: int) -> DataFrame:
    """The n riskiest rows."""
    return top_rows(queue, n, F.col("fused_risk").desc(), F.md5("message_id"), "message_id")


def queue_view(queue: DataFrame, band: str = "All", status: str = "All") -> DataFrame:
    """Filtered display columns; risk in whole percent, CLV in whole units."""
    kept = queue
    if band != "All":
        kept = kept.filter(F.col("band") == band)
    if status != "All":
        kept = kept.filter(F.col("status") == status)
    return kept.select(*[
        F.rint(F.col(c) * 100).cast("int").alias(c) if c == "fused_risk"
        else whole(F.col(c)).alias(c) if c == "clv_aed" else F.col(c) for c in VIEW_COLUMNS])


def attach_text(selected: DataFrame, messages: DataFrame) -> DataFrame:
    """Full records of selected queue rows. The selection is written, because it is read twice: its
    keys filter the texts where they are scanned, so the exchange grows with the selection."""
    chosen = written(selected, "selection")
    texts = may_match(messages.select("message_id", "text"), chosen, "message_id")
    return chosen.join(texts, "message_id")


def queue_summary(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count("*").alias("queue_size"),
        F.count_if(F.col("status") == "Pending Review").alias("pending"),
        F.count_if(F.col("band") == "Critical").alias("critical"),
        F.count_if(F.col("action") == "dignified_goodbye").alias("confirmed_leavers"))
