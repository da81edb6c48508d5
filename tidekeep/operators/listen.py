"""Messages to structured signals: a map-only stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities as ent
from ..functions import text as tx
from ..lexicon import DEFAULT, Lexicon
from ..schemas import NO_CUSTOMER

SIGNAL_COLUMNS = ["message_id", "customer_id", "text", "language", "language_confidence",
                  "issue_type", "issue_confidence", "churn_signal", "churn_signal_confidence",
                  "leaving_confirmed", "entities", "classifier"]


LOW = "_low"


def lowered(df: DataFrame, text: str = "text") -> Column:
    """The lower-cased text: the shared ``_low`` column when an earlier stage made one."""
    return F.col(LOW) if LOW in df.columns and text == "text" else F.lower(text)


def clean_inbox(raw: DataFrame) -> DataFrame:
    """Trim texts, drop blank ones, and fill blank ids. Blanks of every kind count."""
    def trimmed(name: str):
        return F.btrim(F.col(name), F.lit(ent.BLANKS))

    def filled(name: str, default: str):
        return F.coalesce(F.nullif(trimmed(name), F.lit("")), F.lit(default)).alias(name)

    kept = raw.withColumn("text", trimmed("text")).filter(F.length("text") > 0)
    return kept.select(*[
        filled("customer_id", NO_CUSTOMER) if c == "customer_id"
        else filled("message_id", "LIVE") if c == "message_id" else F.col(c)
        for c in raw.columns])


def with_detected_language(df: DataFrame, lex: Lexicon = DEFAULT, text: str = "text",
                           language: str = "language",
                           confidence: str = "language_confidence") -> DataFrame:
    """Detected language of ``text``, replacing the two output columns if present."""
    kept = [c for c in df.columns if c not in (language, confidence)]
    tokens = df.select(*kept, tx.words(lowered(df, text)).alias("_tokens"))
    # One pass drops words of no list; the shares then look at the few that are left.
    known = tokens.select(*kept, F.size("_tokens").alias("_words"),
                          tx.listed_words(F.col("_tokens"), lex).alias("_listed"))
    shares = tx.share_columns(F.col("_listed"), F.col("_words"), lex)
    measured = known.select(*kept, "_words",
                            *[s.alias(f"_share_{n}") for n, s in shares.items()])
    lang, conf = tx.pick_language(tx.in_script(F.col(text), lex), F.col("_words"),
                                  [(n, F.col(f"_share_{n}")) for n in shares], lex)
    return measured.select(*kept, lang.alias(language), conf.alias(confidence))


def with_language_override(df: DataFrame, override: str = "lang_override") -> DataFrame:
    """A given language other than ``auto`` replaces the detected one, with full confidence."""
    given = F.col(override).isNotNull() & ~F.col(override).isin("", "auto")
    return df.withColumns({
        "language": F.when(given, F.col(override)).otherwise(F.col("language")),
        "language_confidence": F.when(given, 1.0).otherwise(F.col("language_confidence"))})


def with_keyword_labels(df: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Keyword issue, churn signal, their confidences, and the leaving flag."""
    kept = [c for c in df.columns if c not in (
        "issue_type", "churn_signal", "issue_confidence", "churn_signal_confidence",
        "leaving_confirmed", "classifier")]
    low = F.col(LOW)
    base = df.select(*[k for k in kept if k != LOW], lowered(df).alias(LOW))
    labelled = (base.withColumns({"leaving_confirmed": tx.leaving_confirmed(low, lex),
                                  "issue_type": tx.keyword_issue(low, lex)})
                .withColumn("churn_signal",
                            tx.keyword_signal(F.col("leaving_confirmed"), low, lex)))
    return labelled.select(
        *kept, "leaving_confirmed", "issue_type",
        tx.issue_confidence(F.col("issue_type"), lex).alias("issue_confidence"),
        "churn_signal",
        tx.signal_confidence(F.col("churn_signal"), lex).alias("churn_signal_confidence"),
        F.lit("heuristic").alias("classifier"))


def with_entities(df: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    kept = [c for c in df.columns if c != "entities"]
    lists = ent.entity_lists(F.col(LOW), lex)
    base = df.select(*[k for k in kept if k != LOW], lowered(df).alias(LOW))
    found = base.select(*kept, *[v.alias(f"_{k}") for k, v in lists.items()])
    return found.select(*kept, ent.as_struct({k: F.col(f"_{k}") for k in lists}).alias("entities"))


def listen(messages: DataFrame, lex: Lexicon = DEFAULT, classify=None) -> DataFrame:
    """The full live path for a table or stream of messages.

    ``classify`` is a DataFrame -> DataFrame stage adding the label columns of a trained model;
    without one the keyword classifier is used.
    """
    classify = classify or (lambda d: with_keyword_labels(d, lex))
    inbox = messages.select("message_id", "customer_id", "text", *[
        c for c in ("lang_override",) if c in messages.columns], F.lower("text").alias(LOW))
    out = classify(with_detected_language(inbox, lex))
    if "lang_override" in out.columns:
        out = with_language_override(out)
    return with_entities(out, lex).select(*SIGNAL_COLUMNS)


def listen_declared(messages: DataFrame, lex: Lexicon = DEFAULT, classify=None) -> DataFrame:
    """The queue path: the declared language is trusted and entities are not needed."""
    classify = classify or (lambda d: with_keyword_labels(d, lex))
    inbox = messages.select("message_id", "customer_id", "text", "language",
                            F.lit(1.0).alias("language_confidence"))
    return classify(inbox)
