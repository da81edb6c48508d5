"""One runnable query per operator over the general tables, keyed by operator id."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities as ent
from ..functions import numeric as nm
from ..functions import risk as rk
from ..functions import text as tx
from ..learning import churn_model as cm
from ..learning import newton as nw
from ..learning import text_model as tm
from ..learning import token_weights as tw
from ..learning import vocabulary as voc
from ..lexicon import EUROPEAN as LEX
from ..operators import decide as dc
from ..operators import guardrails as gr
from ..operators import listen as ls
from ..operators import metrics as mt
from ..operators import outreach as og
from ..operators import ranking as rg
from ..operators import review as rv
from ..operators import splits as sp
from ..operators import timeline as tl
from ..operators.assess import (assess, feature_frame, fixed_scorer, fuse, message_reasons,
                                needs_triage, score_book)
from ..operators.literal import literal_table, lookup
from ..schemas import DECISION_FIELDS, ISSUES, LANGUAGES, NO_CUSTOMER, SIGNALS
from ..sources import adapters as ad
from ..session import shared_dir, written
from ..sources.files import (append_log, booleans_as_ints, event_rows, metric_value, read_audit,
                             read_messages, read_report, write_csv, write_metrics)
from ..streaming import inbox as live
from ..streaming.ledger import Ledger
from . import analytics as an
from . import cases as cs
from . import evaluation as ev
from . import queue as qu
from . import scenarios as sc
from .sql_surface import register

c = F.col
FOLDS = 3


def scorer(profile: DataFrame) -> DataFrame:
    return fixed_scorer(profile, ad.FIXED_INTERCEPT, ad.FIXED_WEIGHTS)


class Tables:
    """The derived tables and stages of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return ad.table(self.spark, self.folder, name)

    profile = cached_property(lambda self: ad.profile(self.spark, self.folder))
    messages = cached_property(lambda self: ad.messages(self.spark, self.folder))
    audit = cached_property(lambda self: ad.audit(self.spark, self.folder))
    inbox = cached_property(lambda self: ad.inbox(self.spark, self.folder))
    candidates = cached_property(lambda self: ad.candidates(self.spark, self.folder))
    low = cached_property(lambda self: self.messages.select(
        "message_id", "text", F.lower("text").alias("low")))
    book = cached_property(lambda self: score_book(self.profile, scorer))
    signals = cached_property(lambda self: ls.listen(self.messages, LEX))
    declared = cached_property(lambda self: ls.listen_declared(self.messages, LEX))
    risk = cached_property(lambda self: assess(self.declared, self.profile, scorer))
    plan = cached_property(lambda self: dc.decide(self.risk))
    queue = cached_property(lambda self: qu.build_queue(self.messages, self.profile, scorer, LEX))
    status = cached_property(lambda self: rv.latest_status(self.audit))
    queue_status = cached_property(lambda self: rv.with_status(self.queue, self.status))
    cases = cached_property(lambda self: cs.run_cases(
        self.messages, self.profile, scorer, LEX, candidates=self.candidates))
    stats = cached_property(lambda self: rv.review_stats(self.audit, self.profile))

    texts = cached_property(lambda self: self.candidates.withColumn("low", F.lower("candidate")))

    @cached_property
    def drafts(self) -> DataFrame:
        """Decided cases with a candidate text, for the single draft checks."""
        return self.plan.join(self.candidates, "message_id", "left").withColumn(
            "low", F.lower("candidate"))

    @cached_property
    def scored_sets(self) -> DataFrame:
        """Two reproducible labellings (keywords; none) on both parts of the stratified split."""
        split = sp.stratified_split(self.messages, sp.message_stratum(), "message_id", 0.2)
        parts = split.select("message_id", F.when(c("held_out"), "held_out").otherwise("rest")
                             .alias("dataset"))
        keyword = ls.with_keyword_labels(self.messages, LEX).select(
            F.lit("keywords").alias("model"), "message_id", c("issue_type").alias("pred_issue"),
            c("churn_signal").alias("pred_signal"))
        constant = self.messages.select(
            F.lit("constant").alias("model"), "message_id", F.lit("General_Query")
            .alias("pred_issue"), F.lit("Low").alias("pred_signal"))
        return ev.with_truth(ev.stack([keyword, constant]).join(parts, "message_id"),
                             self.messages)

    @cached_property
    def keyword_scored(self) -> DataFrame:
        return ev.with_truth(ev.predictions(ls.with_keyword_labels(self.messages, LEX),
                                            "keywords", "all"), self.messages)

    @cached_property
    def outcome(self) -> DataFrame:
        """Churn truth and prediction per customer."""
        return self.book.select("customer_id", "nationality_region", "behaviour_risk",
                                c("churned").cast("int").alias("actual"),
                                cm.hard_label("behaviour_risk").alias("predicted"))

    @cached_property
    def customer_parts(self) -> DataFrame:
        """The book with ``held_out``: a quarter of each outcome, which no churn model sees."""
        book = written(self.profile, "book")
        return sp.stratified_split(book, c("churned").cast("string"), "customer_id", 0.25)

    @cached_property
    def churn_fit(self) -> nw.LogisticFit:
        return nw.fit(self.customer_parts.filter(~c("held_out")))

    @cached_property
    def held_out(self) -> DataFrame:
        """Truth and prediction of the customers the fitted model has not seen."""
        return held_out_outcome(self.churn_fit(self.customer_parts.filter("held_out")))

    unseen = cached_property(lambda self: ad.unseen(self.spark, self.folder))

    @cached_property
    def message_parts(self) -> DataFrame:
        """Messages with part (train, validation, test) and, for train, a fold."""
        return tm.train_test(self.messages).withColumn(
            "fold", F.when(c("part") == "train", tm.fold("message_id", FOLDS)))

    @cached_property
    def counts_classifier(self) -> tw.WeightedClassifier:
        """The count model of the train part."""
        weights = tw.from_counts(self.message_parts.filter("part = 'train'"))
        return tw.WeightedClassifier(written(weights, "count-weights"), LEX, "counts")


def held_out_outcome(scored: DataFrame) -> DataFrame:
    return scored.select("customer_id", "nationality_region", "churned", "behaviour",
                         c("churned").cast("int").alias("actual"),
                         cm.hard_label("behaviour").alias("predicted"))


Query = Callable[[Tables], DataFrame]
CATALOG: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        CATALOG[name] = fn
        return fn
    return add


def joined(values: Column, sep: str = "|") -> Column:
    return F.array_join(values, sep)


def r6(value: Column) -> Column:
    return F.round(value, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({n: r6(c(n)) for n in columns})


def money_list(values: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(
        values, lambda v: v.cast("decimal(38,2)").cast("string")), "|"), F.lit(""))


# ------------------------------------------------------------ sources and projections
query("src_1_profile_scan")(lambda t: booleans_as_ints(t.profile))


@query("src_2_message_scan")
def _message_file(t: Tables) -> DataFrame:
    """The messages through a CSV file: texts have line breaks and quotes."""
    path = shared_dir(t.spark, "messages-csv")
    write_csv(t.messages, path)
    return read_messages(t.spark, path)


@query("src_3_audit_log")
def _audit_log(t: Tables) -> DataFrame:
    """The log through its JSON lines, appended twice over."""
    path = shared_dir(t.spark, "audit-log")
    rows = t.audit.select("seq", "timestamp", "type", "step", "message_id", "human_verdict",
                          "fused_risk", "leaving_confirmed")
    append_log(rows.filter("seq % 2 = 0"), path)
    append_log(rows.filter("seq % 2 = 1"), path)
    return read_audit(t.spark, path).select(rows.columns)


@query("snk_2_event_rows")
def _event_rows(t: Tables) -> DataFrame:
    """Clicks logged as events: a log column among the extra fields stays a column, the others
    come back from the map as text, whole numbers and nulls included."""
    path = shared_dir(t.spark, "event-log")
    clicks = t.raw("events").filter("event_type = 'click'")
    append_log(event_rows(
        clicks, F.lit("Page clicked"), F.lit("customer"),
        F.concat(F.lit("event "), c("event_id").cast("string")),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), confidence=c("value") / 7.0,
        extras={"customer_id": ad.customer_key(c("user_id")), "number": c("event_id"),
                "odd": F.when(c("event_id") % 2 == 1, "yes")}), path)
    return read_audit(t.spark, path).select(
        "timestamp", "type", "step", "actor", "summary", "status", "confidence", "customer_id",
        c("extras")["number"].alias("number"), c("extras")["odd"].alias("odd"))


@query("snk_3_metric_rows")
def _metric_rows(t: Tables) -> DataFrame:
    """The accuracy report through its file."""
    path, report = shared_dir(t.spark, "metrics"), CATALOG["agg_17_accuracy"](t)
    write_metrics(report, path)
    return t.spark.read.schema(report.schema).json(path)


def _report(t: Tables) -> DataFrame:
    """Counts per source as a nested report, written and read back, with leaves that look like
    objects and are none."""
    counts = t.raw("documents").groupBy("source").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    by_source = F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "source", F.struct("n", "chars")))))
    report = counts.agg(F.struct(by_source.alias("sources"), F.sum("n").alias("n")).alias("data"))
    path = shared_dir(t.spark, "report")
    write_metrics(report.select("data", F.lit("{not json").alias("note"),
                                F.lit('{"x":1}').alias("quoted")), path)
    return read_report(t.spark, path, "counts")


query("src_4_report_leaves")(_report)
query("prj_14_report_metric")(lambda t: metric_value(_report(t), "data.sources.src0.n"))


query("prj_1_boolean_casts")(lambda t: booleans_as_ints(t.profile, [
    "salary_credit_active", "intl_transfer_spike", "churned"]).select(
    "customer_id", "salary_credit_active", "intl_transfer_spike", "churned"))
query("prj_2_feature_projection")(lambda t: feature_frame(t.profile))
query("prj_3_queue_view")(lambda t: qu.queue_view(t.queue_status))
query("prj_4_label_encoding")(lambda t: t.messages.select(
    "message_id", tm.label_index("issue_type", ISSUES).alias("issue_no"),
    tm.label_index("churn_signal", SIGNALS).alias("signal_no")))
query("prj_5_stratum_key")(lambda t: t.messages.select(
    "message_id", sp.message_stratum().alias("stratum")))
query("prj_6_audit_view")(lambda t: rv.audit_view(t.audit))


@query("prj_7_decision_rows")
def _decision_rows(t: Tables) -> DataFrame:
    reviewed = rv.apply_review(t.cases.drop("status"), rv.first_verdict(t.audit).drop("seq"))
    rows = rv.decision_rows(reviewed, F.lit("2024-02-01T00:00:00"))
    assert rows.columns == DECISION_FIELDS
    return rows.withColumn("guardrail_flags", joined(c("guardrail_flags")))


query("prj_8_language_override")(lambda t: ls.with_language_override(
    ls.with_detected_language(ls.clean_inbox(t.inbox), LEX)).select(
    "message_id", "text", "language", r6(c("language_confidence")).alias("language_confidence")))
query("prj_9_input_hygiene")(lambda t: ls.clean_inbox(t.inbox).select(
    "message_id", "customer_id", "text"))
query("prj_10_previews")(lambda t: t.messages.select("message_id", *[
    F.substring("text", 1, n).alias(f"preview_{n}") for n in (140, 90, 70, 200)]))
query("prj_11_display_strings")(lambda t: t.book.select(
    "customer_id", nm.money(c("clv_estimate_aed")).alias("clv_text"),
    nm.percent(nm.round_exact(c("behaviour_risk"), 3)).alias("risk_text")))
query("prj_12_label_cleanup")(lambda t: t.messages.select(
    "message_id", F.replace("issue_type", F.lit("_"), F.lit(" ")).alias("issue_label"),
    F.substring_index(F.concat(F.lit("num__"), F.col("churn_signal")), "__", -1).alias("feature"),
    F.split_part(F.concat_ws(" | ", "message_id", "language", F.substring("text", 1, 70)),
                 F.lit(" | "), F.lit(1)).alias("picked_id")))
query("prj_13_compact_audit")(lambda t: rv.newest_first(rv.compact_view(t.audit)))

# ------------------------------------------------------------ filters
query("fil_1_point_lookup")(lambda t: t.profile.filter(
    c("customer_id") == t.audit.agg(F.max_by("customer_id", "seq").alias("id")).scalar()).select(
    "customer_id", "segment", "tenure_months", "clv_estimate_aed"))
query("fil_2_queue_filter")(lambda t: qu.queue_view(t.queue_status, "Critical",
                                                    "Pending Review"))
query("fil_3_at_risk")(lambda t: t.book.filter(an.at_risk()).select(
    "customer_id", "segment", "band", r6(c("behaviour_risk")).alias("behaviour_risk")))
query("fil_4_message_search")(lambda t: sc.first_matches(t.messages, "message_id", {
    "found": sc.matches({"issue_type": "Fees_Charges", "churn_signal": "Medium"}, "FRUSTRATED"),
    "fallback": sc.matches({"issue_type": "Fees_Charges"}, "no such words anywhere")}))
query("fil_5_customer_search")(lambda t: sc.pick_customers(t.profile))
query("fil_6_reviewed_rows")(lambda t: rv.reviewed(t.audit).select(
    "seq", "message_id", "customer_id", "human_verdict"))
query("fil_7_high_bands")(lambda t: t.queue.filter(c("band").isin("High", "Critical")).select(
    "message_id", "customer_id", "band", "fused_risk"))
query("fil_8_non_english_share")(lambda t: rounded(t.messages.agg(
    F.avg((c("language") != "en").cast("double")).alias("non_english_share")),
    "non_english_share"))

# ------------------------------------------------------------ text and entities
query("txt_1_arabic_script")(lambda t: t.messages.select(
    "message_id", tx.in_script(c("text"), LEX).alias("arabic")))
query("txt_2_words")(lambda t: t.low.select("message_id", tx.words(c("low")).alias("w")).select(
    "message_id", F.size("w").alias("n_words"), F.md5(joined(c("w"), " ")).alias("words_digest")))
query("txt_3_lexicon_shares")(lambda t: t.low.select(
    "message_id", tx.words(c("low")).alias("w")).select(
    "message_id", F.size("w").alias("n"), tx.listed_words(c("w"), LEX).alias("w")).select(
    "message_id", *[r6(s).alias(f"share_{n}")
                    for n, s in tx.share_columns(c("w"), c("n"), LEX).items()]))
query("txt_4_detect_language")(lambda t: rounded(ls.with_detected_language(
    t.messages.select("message_id", "text"), LEX), "language_confidence").select(
    "message_id", "language", "language_confidence"))
query("txt_5_leaving_confirmed")(lambda t: t.low.select(
    "message_id", tx.leaving_confirmed(c("low"), LEX).alias("leaving_confirmed")))
query("ent_1_amounts")(lambda t: t.low.select("message_id", money_list(ent.amounts(c("low")))
                                              .alias("amounts")))
query("ent_2_dates")(lambda t: t.low.select(
    "message_id", joined(ent.phrases_found(c("low"), LEX.dates)).alias("dates")))
query("ent_3_destinations")(lambda t: t.low.select(
    "message_id", joined(ent.gazetteer_hits(c("low"), LEX.countries)).alias("destinations")))
query("ent_4_products")(lambda t: t.low.select(
    "message_id", joined(ent.gazetteer_hits(c("low"), LEX.products)).alias("products")))


def _entity_text() -> list[Column]:
    e = c("entities")
    lists = [F.array_join(e[n], "|").alias(n) for n in ("dates", "destinations", "products")]
    return [F.nullif(money_list(e["amounts_aed"]), F.lit("")).alias("amounts"), *lists]


query("ent_5_extract_entities")(lambda t: ls.with_entities(t.messages, LEX).select(
    "message_id", *_entity_text()))
query("clf_1_keyword_issue")(lambda t: ls.with_keyword_labels(
    t.messages.select("message_id", "text"), LEX).select(
    "message_id", "issue_type", "issue_confidence"))
query("clf_2_keyword_signal")(lambda t: ls.with_keyword_labels(
    t.messages.select("message_id", "text"), LEX).select(
    "message_id", "churn_signal", "churn_signal_confidence"))


@query("clf_4_token_ids")
def _token_ids(t: Tables) -> DataFrame:
    vocabulary = voc.vocabulary_list(voc.fit_vocabulary(t.messages))
    return voc.vectorise(t.messages, vocabulary).select(
        "message_id", F.array_join(c("token_ids").cast("array<string>"), " ").alias("token_ids"))


query("clf_5_vocabulary")(lambda t: voc.fit_vocabulary(t.messages))
query("clf_7_reply_labels")(lambda t: t.messages.select(
    "message_id", tx.reply_label(c("text"), SIGNALS).alias("signal"),
    tx.reply_label(F.concat_ws(" ", "text", "issue_type"), ISSUES).alias("issue")))
query("clf_8_listen")(lambda t: t.signals.select(
    "message_id", "customer_id", "text", "language",
    r6(c("language_confidence")).alias("language_confidence"), "issue_type", "issue_confidence",
    "churn_signal", "churn_signal_confidence", "leaving_confirmed", *_entity_text(),
    "classifier"))

# ------------------------------------------------------------ risk
query("rsk_1_behaviour_score")(lambda t: t.book.select(
    "customer_id", r6(c("behaviour_risk")).alias("behaviour_risk")))
query("rsk_2_neutral_prior")(lambda t: t.risk.select("message_id", "behaviour_score",
                                                     "profile_found"))
query("rsk_3_behaviour_reasons")(lambda t: t.profile.select(
    "customer_id", joined(rk.behaviour_reasons()).alias("reasons")))
query("rsk_4_text_score")(lambda t: t.declared.select(
    "message_id", rk.text_score(c("churn_signal")).alias("text_score")))
query("rsk_5_fusion")(lambda t: fuse(t.declared, t.profile, scorer, with_reasons=False).select(
    "message_id", r6(c("_mixed")).alias("mixed_risk")))
query("rsk_6_leaving_floor")(lambda t: fuse(t.declared, t.profile, scorer, with_reasons=False)
                             .select("message_id", r6(c("_fused")).alias("floored_risk")))
query("rsk_7_headline_reasons")(lambda t: fuse(t.declared, t.profile, scorer).select(
    "message_id", joined(message_reasons()).alias("reasons")))
query("rsk_8_triage_flag")(lambda t: t.declared.select(
    "message_id", needs_triage(rk.text_score(c("churn_signal"))).alias("needs_human_triage")))
query("rsk_9_banding")(lambda t: t.risk.select("message_id", "risk_band"))
query("rsk_10_rounding")(lambda t: t.risk.select("message_id", "behaviour_score", "fused_risk"))
query("rsk_11_profile_defaults")(lambda t: t.risk.select(
    "message_id", "segment", "clv_estimate_aed", "profile_found"))
RISK_FIELDS = ["message_id", "customer_id", "behaviour_score", "text_score", "fused_risk",
               "risk_band", "needs_human_triage", "segment", "clv_estimate_aed", "profile_found"]
query("rsk_12_assess_risk")(lambda t: t.risk.select(
    *RISK_FIELDS, joined(c("reasons")).alias("reasons")))
query("rsk_13_reviewer_checklist")(lambda t: t.risk.select(
    "message_id", joined(rk.reviewer_checklist()).alias("checks")))
query("rsk_14_clv_at_risk")(lambda t: t.risk.select(
    "message_id", F.round(c("fused_risk") * c("clv_estimate_aed"), 4).alias("clv_at_risk")))
query("rsk_15_confidence_tier")(lambda t: t.signals.select("message_id", *[
    rk.confidence_tier(c(n)).alias(f"{n}_tier") for n in (
        "language_confidence", "issue_confidence", "churn_signal_confidence")]))

# ------------------------------------------------------------ decision and drafts
query("act_1_decision_table")(lambda t: t.plan.select(
    "message_id", "rule_id", "action", "offer_value_aed"))
query("act_2_offer_economics")(lambda t: t.plan.filter(c("rule_id").isin(
    "2a", "2a'", "2b", "2b'")).select(
    "message_id", "action", "offer_value_aed",
    F.round(dc.OFFER_CAP * c("clv_estimate_aed"), 4).alias("cap_aed")))
query("act_3_rationale")(lambda t: t.plan.select("message_id", joined(c("rationale"))
                                                 .alias("rationale")))
query("act_4_within_budget")(lambda t: t.plan.select("message_id", "offer_value_aed",
                                                     "offer_within_budget"))
query("act_5_action_labels")(lambda t: t.plan.select("message_id", "action", "action_label"))
PLAN_FIELDS = ["message_id", "customer_id", "action", "action_label", "rule_id",
               "offer_value_aed", "offer_within_budget", "draft_message", "draft_language",
               "draft_source"]
query("act_6_decide_and_act")(lambda t: og.serve(t.plan, LEX).select(
    *PLAN_FIELDS, joined(c("rationale")).alias("rationale"),
    joined(c("guardrail_flags")).alias("guardrail_flags")))


def _speaking(t: Tables) -> DataFrame:
    """Decided cases of the live path, whose detected languages include the template ones."""
    return dc.decide(assess(t.signals, t.profile, scorer))


query("drf_1_template_lookup")(lambda t: og.with_template(_speaking(t)).select(
    "message_id", "action", "language", "template_language"))
query("drf_2_template_fill")(lambda t: og.with_template(_speaking(t)).select(
    "message_id", "template_text"))
query("drf_3_serve_decision")(lambda t: t.cases.select(
    "message_id", "draft_message", "draft_language", "draft_source",
    joined(c("guardrail_flags")).alias("guardrail_flags")))
query("drf_4_prompt_text")(lambda t: og.with_prompt(t.plan, "Warm").select(
    "message_id", "prompt_used"))
query("grd_1_urgency")(lambda t: t.texts.select(
    "message_id", joined(gr.urgency_hits(c("low"), LEX)).alias("urgency")))
query("grd_2_placeholders")(lambda t: t.texts.select(
    "message_id", joined(gr.placeholders(c("candidate"))).alias("placeholders")))
query("grd_3_invented_amounts")(lambda t: t.texts.filter(c("candidate").isNotNull()).select(
    "message_id", F.array_distinct(F.array_compact(gr.draft_amounts(c("low")))).alias("amounts"))
    .join(t.plan.select("message_id", "offer_value_aed"), "message_id").select(
    "message_id", money_list(gr.invented_amounts(c("amounts"), c("offer_value_aed")))
    .alias("invented")))
query("grd_4_retention_pressure")(lambda t: t.plan.select("message_id", "action").join(
    t.texts.select("message_id", tx.contains_any(c("low"), LEX.pressure).alias("pressing")),
    "message_id", "left").select("message_id", (
        (c("action") == "dignified_goodbye") & c("pressing")).alias("pressure")))
query("grd_5_too_short")(lambda t: t.texts.select(
    "message_id", gr.word_count(c("candidate")).alias("n_words"),
    gr.too_short(c("candidate")).alias("short")))
query("grd_6_language_mismatch")(lambda t: ls.with_detected_language(
    t.messages.select("message_id", c("language").alias("wanted")).join(
        t.candidates.filter(c("candidate").isNotNull()), "message_id").select(
        "message_id", "wanted", c("candidate").alias("text")), LEX).select(
    "message_id", "wanted", c("language").alias("detected"),
    (c("language") != c("wanted")).alias("mismatch")))

# ------------------------------------------------------------ joins
query("joi_1_message_profile")(lambda t: t.messages.select("message_id", "customer_id").join(
    t.profile.select("customer_id", "segment", "clv_estimate_aed"), "customer_id", "left"))
query("joi_2_queue_status")(lambda t: t.queue_status.select("message_id", "fused_risk", "band",
                                                            "status"))
query("joi_3_audit_segment")(lambda t: t.stats.select("seq", "customer_id", "human_verdict",
                                                      "segment"))
query("joi_4_action_label_template")(lambda t: og.with_template(_speaking(t)).select(
    "message_id", "action", lookup(c("action"), dc.ACTION_LABELS).alias("label"),
    "template_language"))
query("joi_5_selected_records")(lambda t: qu.attach_text(
    t.queue.filter(c("band") == "Critical").select("message_id", "customer_id", "band",
                                                   "fused_risk"), t.messages))
query("joi_6_prediction_truth")(lambda t: t.keyword_scored)
query("joi_7_report_grid")(lambda t: ev.report_grid(t.scored_sets))
query("joi_8_scenarios")(lambda t: sc.build_scenarios(t.messages, t.profile))

# ------------------------------------------------------------ aggregates
query("agg_1_mean_risk_by_segment")(lambda t: rounded(an.mean_risk_by_segment(t.book),
                                                      "mean_risk"))
query("agg_2_issue_distribution")(lambda t: an.distribution(t.messages, "issue_type"))
query("agg_3_signal_distribution")(lambda t: an.signal_distribution(t.messages))
query("agg_4_driver_counts")(lambda t: an.driver_counts(t.book))
query("agg_5_mean_clv_by_band")(lambda t: rounded(an.mean_clv_by_band(t.book), "mean_clv"))
query("agg_6_language_distribution")(lambda t: an.distribution(t.messages, "language"))
query("agg_7_action_distribution")(lambda t: an.distribution(t.queue, "recommended"))
query("agg_8_review_outcomes")(lambda t: an.distribution(rv.reviewed(t.audit), "human_verdict"))
query("agg_9_review_rates")(lambda t: rounded(an.review_rates(t.stats), "approval_rate",
                                              "override_rate", "rejection_rate"))
query("agg_10_disproportion")(lambda t: rounded(an.disproportion(t.stats), "rejection_rate",
                                                "overall_rate"))
query("agg_11_segment_distribution")(lambda t: rounded(an.segment_distribution(t.book),
                                                       "mean_risk"))
query("agg_12_region_audit")(lambda t: rounded(an.region_audit(t.book), "mean_predicted_risk",
                                               "actual_churn_rate"))
query("agg_13_exposure_by_segment")(lambda t: an.exposure_by_segment(t.book))
query("agg_14_overview")(lambda t: rounded(an.overview(t.book, t.messages), "share_at_risk",
                                           "non_english_share"))
query("agg_15_queue_summary")(lambda t: qu.queue_summary(t.queue_status))
query("agg_16_segment_view")(lambda t: an.segment_view(t.book))
query("agg_17_accuracy")(lambda t: rounded(ev.bakeoff(t.scored_sets), "issue_acc", "signal_acc"))
query("agg_18_class_report")(lambda t: rounded(mt.class_report(
    t.keyword_scored, "issue_type", "pred_issue", ISSUES), "precision", "recall", "f1"))
query("agg_19_confusion")(lambda t: mt.confusion(t.outcome, "actual", "predicted", [0, 1]))
query("agg_20_roc_auc")(lambda t: rounded(mt.roc_auc(
    t.outcome.withColumn("behaviour_risk", r6(c("behaviour_risk"))), "actual",
    "behaviour_risk"), "auc"))


@query("agg_21_region_audit_held_out")
def _region_held_out(t: Tables) -> DataFrame:
    held = sp.stratified_split(t.outcome, c("actual").cast("string"), "customer_id", 0.25).filter(
        "held_out")
    return rounded(held.groupBy("nationality_region").agg(
        F.count("*").alias("n"), F.avg("behaviour_risk").alias("mean_predicted_risk"),
        F.avg("actual").alias("actual_churn_rate")), "mean_predicted_risk",
        "actual_churn_rate").orderBy("nationality_region")


query("agg_18_report_fitted")(lambda t: rounded(mt.class_report(
    t.held_out, "actual", "predicted", [0, 1]), "precision", "recall", "f1"))
query("agg_19_confusion_fitted")(lambda t: mt.confusion(t.held_out, "actual", "predicted", [0, 1]))
query("agg_20_roc_auc_fitted")(lambda t: rounded(mt.roc_auc(
    t.held_out.withColumn("behaviour", r6(c("behaviour"))), "actual", "behaviour"), "auc"))
query("agg_21_region_audit_fitted")(lambda t: rounded(t.held_out.groupBy("nationality_region").agg(
    F.count("*").alias("n"), F.avg("behaviour").alias("mean_predicted_risk"),
    F.avg("actual").alias("actual_churn_rate")), "mean_predicted_risk", "actual_churn_rate"))

query("agg_22_issue_signal_crosstab")(lambda t: ev.crosstab(
    t.messages, "issue_type", "churn_signal", SIGNALS))
query("agg_22_language_signal_crosstab")(lambda t: ev.crosstab(
    t.messages, "language", "churn_signal", SIGNALS))
query("agg_23_region_churn_shares")(lambda t: ev.row_shares(ev.crosstab(
    t.profile.withColumn("churned", c("churned").cast("string")), "nationality_region",
    "churned", ["false", "true"]), "nationality_region"))
query("agg_24_driver_means")(lambda t: rounded(ev.driver_means(t.profile), "balance_trend_3m",
                                               "salary_credit_active", "intl_transfer_spike"))


def outreach_checks(t: Tables) -> DataFrame:
    """Language check of every candidate and of what is served instead."""
    served = t.cases.filter(c("action") != "human_triage").select(
        "message_id", "action", "language", "draft_source", "draft_language", "draft_message",
        "guardrail_flags")
    seen = ls.with_detected_language(served, LEX, text="draft_message", language="seen",
                                     confidence="_seen_conf")
    return seen.select(
        "message_id", "action", "language", c("draft_source").alias("served_by"),
        c("draft_language").alias("served_language"),
        (~F.exists("guardrail_flags", lambda f: f.startswith("wrong language")))
        .alias("wrote_customer_language"),
        (c("seen") == c("language")).alias("served_language_verified"),
        joined(c("guardrail_flags")).alias("guardrail_flags"),
        F.substring("draft_message", 1, 140).alias("draft_preview"))


query("agg_25_outreach_summary")(lambda t: og.outreach_summary(outreach_checks(t)))
query("agg_26_bakeoff_table")(lambda t: rounded(
    ev.bakeoff_table(ev.bakeoff(t.scored_sets), ["held_out", "rest"]), "held_out_issue_acc",
    "held_out_signal_acc", "rest_issue_acc", "rest_signal_acc"))
query("agg_27_calm_leavers")(lambda t: rounded(an.calm_leavers(t.messages, t.book),
                                               "calm_share"))
query("agg_28_value_concentration")(lambda t: rounded(an.value_concentration(t.book),
                                                      "top_share"))
query("agg_29_segment_plays")(lambda t: rounded(an.segment_plays(t.book), "mean_clv"))
query("agg_30_churn_base_rate")(lambda t: rounded(an.churn_base_rate(t.profile), "base_rate"))

# ------------------------------------------------------------ order
query("srt_1_ranked_queue")(lambda t: qu.ranked_queue(t.queue).select(
    "rank", "message_id", "fused_risk", "band"))
query("srt_2_region_order")(lambda t: t.outcome.groupBy("nationality_region").agg(
    F.count("*").alias("n")).orderBy("nationality_region"))
query("srt_3_newest_first")(lambda t: rv.newest_first(rv.audit_view(t.audit)))
# The weight of a driver is what the profiles say: its correlation with churn.
query("srt_4_drivers_ascending")(lambda t: t.profile.agg(*[
    F.corr(c(f).cast("double"), c("churned").cast("int").cast("double")).alias(f)
    for f in ad.FIXED_WEIGHTS]).select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), r6(c(f)).alias("weight"))
        for f in ad.FIXED_WEIGHTS]))).orderBy("weight", "feature"))
query("srt_5_counts_descending")(lambda t: an.distribution(t.audit, "action"))
query("win_1_first_match")(lambda t: sc.pick_messages(t.messages))
query("win_2_latest_verdict")(lambda t: t.status)
query("lim_1_first_items")(lambda t: t.drafts.select(
    "message_id", F.size("reasons").alias("n_reasons"),
    F.size(gr.placeholders(c("candidate"))).alias("n_placeholders")))

# ------------------------------------------------------------ sets, quality, splits


@query("set_1_text_leakage")
def _leakage(t: Tables) -> DataFrame:
    split = sp.stratified_split(t.messages, sp.message_stratum(), "message_id", 0.2)
    # The texts as they came: their copies carry other closing lines as messages.
    whole = t.raw("documents").select(ad.message_key(c("doc_id")).alias("message_id"), "text")
    split = split.select("message_id", "held_out").join(whole, "message_id")
    return ev.shared_texts(split.filter("held_out"), split.filter(~c("held_out")))


query("set_3_stacked_predictions")(lambda t: t.scored_sets.select(
    "model", "dataset", "message_id", "pred_issue", "pred_signal"))
query("dq_1_language_mix")(lambda t: an.distribution(t.signals, "language"))
query("dq_2_cell_balance")(lambda t: ev.unbalanced_cells(t.messages, 12))
query("dq_4_orphans")(lambda t: ev.orphans(t.messages, t.profile).select("message_id",
                                                                         "customer_id"))
query("spl_1_message_split")(lambda t: sp.stratified_split(
    t.messages, sp.message_stratum(), "message_id", 0.2).select("message_id", "held_out"))
query("spl_2_label_split")(lambda t: sp.stratified_split(
    t.profile, c("churned").cast("string"), "customer_id", 0.25).select("customer_id",
                                                                        "held_out"))
query("spl_3_folds")(lambda t: t.message_parts.select("message_id", "part", "fold"))
query("spl_3_validation_tail")(lambda t: tm.train_test(t.messages).select("message_id", "part"))

# ------------------------------------------------------------ learning
query("ml_1_standardised")(lambda t: rounded(cm.standardised(t.profile), *cm.NUMERIC,
                                             *cm.BOOLEAN))


@query("ml_2_one_hot_segment")
def _one_hot(t: Tables) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    frame = cm.labelled_features(t.profile)
    encoded = Pipeline(stages=cm.feature_stages()).fit(frame).transform(frame)
    return encoded.select("customer_id", "segment", F.array_join(vector_to_array("_onehot").cast(
        "array<string>"), " ").alias("one_hot"))


# The churn models are fitted to three quarters of the book and judged on the rest.
query("ml_3_logistic_scores")(lambda t: t.held_out.select("customer_id", "churned",
                                                          r6(c("behaviour")).alias("behaviour")))
query("ml_3_optimality")(lambda t: nw.optimality(
    t.churn_fit, t.customer_parts.filter(~c("held_out"))).select(
    "feature", (F.round("gradient", 9) + 0.0).alias("gradient")))


def _trees_held_out(t: Tables) -> DataFrame:
    model = cm.fit_trees(t.customer_parts.filter(~c("held_out")).drop("held_out"))
    return held_out_outcome(cm.scorer(model)(t.customer_parts.filter("held_out").drop("held_out")))


query("ml_4_boosted_trees_scores")(lambda t: _trees_held_out(t).select(
    "customer_id", "churned", r6(c("behaviour")).alias("behaviour")))


@query("ml_4_boosted_trees_report")
def _trees_report(t: Tables) -> DataFrame:
    """What must hold of any fitted trees: a score in [0, 1] for every held-out customer, and the
    leavers above the others on average."""
    mean = F.avg("behaviour")
    per = written(_trees_held_out(t).groupBy("actual").agg(
        F.count("behaviour").alias("n"), mean.alias("mean"),
        F.bool_and(c("behaviour").between(0.0, 1.0)).alias("in_range")), "trees-report")
    spread = per.agg((F.max_by("mean", "actual") > F.min_by("mean", "actual")).alias("apart"))
    return per.select("actual", "n", "in_range", spread.scalar().alias("leavers_above"))


@query("snk_4_saved_model")
def _saved_model(t: Tables) -> DataFrame:
    """Held-out scores of the model as it comes back from its folder."""
    path = shared_dir(t.spark, "churn-model")
    t.churn_fit.save(t.spark, path)
    again = nw.LogisticFit.load(t.spark, path)
    return held_out_outcome(again(t.customer_parts.filter("held_out"))).select(
        "customer_id", "churned", r6(c("behaviour")).alias("behaviour"))


@query("src_5_absent_model")
def _absent_model(t: Tables) -> DataFrame:
    """Nothing saved: every customer gets the neutral prior."""
    none = nw.LogisticFit.load(t.spark, shared_dir(t.spark, "no-model"))
    return score_book(t.profile, none).select("customer_id", "behaviour_risk", "band")


@query("clf_3_classifier_choice")
def _classifier_choice(t: Tables) -> DataFrame:
    """Labels by the saved classifier, and by the keywords where nothing was saved."""
    path = shared_dir(t.spark, "classifier")
    t.counts_classifier.save(path)
    rows = []
    for folder in (path, shared_dir(t.spark, "no-classifier")):
        served = tw.WeightedClassifier.load(t.spark, folder, LEX, "counts") or _keywords
        rows.append(served(t.messages.select("message_id", "text")).select(
            "message_id", "issue_type", "churn_signal", "classifier"))
    return ev.stack(rows)


query("ml_5_hard_label")(lambda t: t.outcome.select("customer_id", "actual", "predicted"))
query("ml_6_coefficients")(lambda t: nw.coefficients(t.churn_fit, t.spark).select(
    "feature", (F.round("coefficient", 4) + 0.0).alias("coefficient")).orderBy("coefficient",
                                                                               "feature"))


def _trained_classifier(t: Tables) -> tm.TextClassifier:
    parts = sp.stratified_split(t.messages, sp.message_stratum(), "message_id", 0.2)
    return tm.fit(parts.filter(~c("held_out")), LEX)


@query("ml_7_text_heads")
def _text_heads(t: Tables) -> DataFrame:
    return _trained_classifier(t)(t.messages.select("message_id", "text")).select(
        "message_id", "issue_type", "churn_signal")


query("ml_8_trained_queue")(lambda t: qu.build_queue(
    t.messages, t.profile, cm.scorer(cm.fit_logistic(t.profile)), LEX,
    classify=_trained_classifier(t)))


def _labels(scored: DataFrame) -> DataFrame:
    return rounded(scored, "issue_type_confidence", "churn_signal_confidence")


query("ml_7_count_scores")(lambda t: _labels(tw.scored(t.messages, t.counts_classifier.weights)))


@query("ml_7_weights_agree")
def _weights_agree(t: Tables) -> DataFrame:
    """The written weights of the fitted heads against the model's own vector output."""
    model = _trained_classifier(t)
    own = model(t.messages.select("message_id", "text"))
    table = written(tw.from_heads(model, t.spark), "head-weights")
    both = own.join(tw.scored(t.messages, table).select(
        "message_id", c("issue_type").alias("issue"), c("churn_signal").alias("signal"),
        "issue_type_confidence", c("churn_signal_confidence").alias("signal_confidence")),
        "message_id")
    gap = F.greatest(F.abs(c("issue_confidence") - c("issue_type_confidence")),
                     F.abs(c("churn_signal_confidence") - c("signal_confidence")))
    return both.agg(F.count("*").alias("n"), F.count_if(
        (c("issue") != c("issue_type")) | (c("signal") != c("churn_signal"))).alias("other_labels"),
        (F.max(gap) < 1e-9).alias("same_confidence"))


query("ml_8_count_queue")(lambda t: qu.build_queue(
    t.messages, t.profile, scorer, LEX, classify=t.counts_classifier))


def _bakeoff_rows(t: Tables, models: dict, keep: list[tuple[str, DataFrame]]) -> DataFrame:
    """Truth and predictions of every model on every data set, each set scanned once a model."""
    rows = []
    for dataset, messages in keep:
        base = messages.select("message_id", "text", "language", c("issue_type").alias("_issue"),
                               c("churn_signal").alias("_signal"))
        for name, classify in models.items():
            rows.append(classify(base).select(
                F.lit(name).alias("model"), F.lit(dataset).alias("dataset"), "language",
                c("_issue").alias("issue_type"), c("_signal").alias("churn_signal"),
                c("issue_type").alias("pred_issue"), c("churn_signal").alias("pred_signal")))
    return ev.stack(rows)


def _keywords(df: DataFrame) -> DataFrame:
    return ls.with_keyword_labels(df, LEX)


def _eval_sets(t: Tables) -> list[tuple[str, DataFrame]]:
    return [("held_out", t.message_parts.filter("part = 'test'")), ("unseen", t.unseen)]


query("ml_9_bakeoff_exact")(lambda t: rounded(ev.bakeoff(_bakeoff_rows(
    t, {"keywords": _keywords, "counts": t.counts_classifier}, _eval_sets(t))),
    "issue_acc", "signal_acc"))


@query("ml_9_served")
def _served_model(t: Tables) -> DataFrame:
    """The validation part decides which classifier serves: the better one by both accuracies
    together, of equal ones the keywords."""
    rows = _bakeoff_rows(t, {"keywords": _keywords, "counts": t.counts_classifier},
                         [("validation", t.message_parts.filter("part = 'validation'"))])
    report = written(ev.bakeoff(rows).filter("language = '(all)'"), "validation-report")
    best = report.agg(F.max_by("model", F.struct(
        F.round(c("issue_acc") + c("signal_acc"), 9), c("model"))).alias("model"))
    return rounded(report.select("model", "n", "issue_acc", "signal_acc", (
        c("model") == best.scalar()).alias("served")), "issue_acc", "signal_acc")


@query("ml_9_tuning")
def _tuning(t: Tables) -> DataFrame:
    tuned = tm.tune(t.message_parts.filter("part = 'train'"), folds=FOLDS)
    chosen = tm.best_regs(tuned)
    return literal_table(t.spark, ["head", "reg", "mean_accuracy", "chosen"], [
        (h, r, a, chosen[h] == r) for h, scores in tuned.items() for r, a in scores.items()])


@query("ml_9_bakeoff")
def _bakeoff(t: Tables) -> DataFrame:
    """All classifiers on the held-out and the unseen messages; the heads with the regularisation
    that cross-validation chose."""
    train = t.message_parts.filter("part = 'train'")
    prepared = tm.prepare(train, folds=FOLDS)
    regs = tm.best_regs(tm.tune(train, folds=FOLDS, prepared=prepared))
    trained = tm.fit(train, LEX, reg=regs, prepared=prepared)
    counts = written(tw.from_counts(train, prepared=prepared), "count-weights")
    prepared.release()
    models = {"trained": trained, "keywords": _keywords,
              "counts": tw.WeightedClassifier(counts, LEX, "counts")}
    return rounded(ev.bakeoff(_bakeoff_rows(t, models, _eval_sets(t))), "issue_acc", "signal_acc")


query("ml_10_scored_book")(lambda t: t.book.select(
    "customer_id", "segment", r6(c("behaviour_risk")).alias("behaviour_risk"), "band"))

# ------------------------------------------------------------ SQL


@query("udf_1_sql_functions")
def _sql_functions(t: Tables) -> DataFrame:
    """Detect, assess and decide in one SQL statement over the registered views."""
    register(t.spark, t.messages, t.profile, scorer, LEX)
    return t.spark.sql("""
        WITH labelled AS (
          SELECT message_id, customer_id, keyword_issue(text) AS issue,
                 churn_intent(text) AS signal, says_leaving(text) AS leaving FROM inbox),
        mixed AS (
          SELECT l.*, behaviour_mix(b.behaviour_risk, signal, leaving) AS risk,
                 coalesce(b.segment, 'Unknown') AS segment,
                 coalesce(cast(b.clv_estimate_aed AS DOUBLE), 0D) AS clv
          FROM labelled l LEFT JOIN book b ON l.customer_id = b.customer_id)
        SELECT message_id, issue, signal, segment, risk_band(risk) AS band,
               decision_rule(needs_human_triage, leaving, risk_band(risk), issue, segment, clv)
                 AS by_function, rule_id AS by_view
        FROM mixed JOIN (SELECT message_id, needs_human_triage, rule_id FROM decisions) d
        USING (message_id)""")


@query("udf_1_sql_views")
def _sql_views(t: Tables) -> DataFrame:
    register(t.spark, t.messages, t.profile, scorer, LEX)
    return t.spark.sql("SELECT message_id, customer_id, lang, issue, signal, fused_risk, band,"
                       " segment, clv_aed, recommended, action, offer FROM queue")


# ------------------------------------------------------------ composites, review, timeline
query("cmp_1_review_queue")(lambda t: t.queue)
CASE_FIELDS = ["message_id", "customer_id", "language", "issue_type", "churn_signal",
               "leaving_confirmed", "fused_risk", "risk_band", "rule_id", "action",
               "offer_value_aed", "draft_message", "draft_language", "draft_source", "status"]
query("cmp_2_run_case")(lambda t: t.cases.select(
    *CASE_FIELDS, joined(c("reasons")).alias("reasons"),
    joined(c("rationale")).alias("rationale"),
    joined(c("guardrail_flags")).alias("guardrail_flags")))
query("cmp_3_outreach_grid")(lambda t: outreach_checks(t).groupBy("action", "language").agg(
    F.count("*").alias("n"), F.count_if("wrote_customer_language").alias("own_language"),
    F.count_if("served_language_verified").alias("verified"),
    F.count_if(c("served_by") == "template").alias("from_template"),
    F.count_if(c("guardrail_flags") != "").alias("flagged")))


def _verdicts(t: Tables) -> DataFrame:
    """Last verdict rows with the override they ask for."""
    last = F.max_by(F.struct("human_verdict", "reviewer_note", "override_action"), rv.log_order())
    return rv.reviewed(t.audit).groupBy("message_id").agg(last.alias("v")).select(
        "message_id", "v.*")


@query("rev_1_review_transition")
def _transition(t: Tables) -> DataFrame:
    """Drafts are rendered for the reviewed cases only, after the join."""
    fields = ["message_id", "action", "action_label", "offer_value_aed", "draft_message"]
    joined_cases = rv.with_verdicts(t.plan, _verdicts(t))
    return rv.reviewed_cases(og.serve(joined_cases, LEX).select(*fields, *rv.VERDICT_FIELDS),
                             fields)


query("rev_2_first_decision")(lambda t: rv.first_verdict(t.audit).select(
    "message_id", "human_verdict", "seq"))
query("tml_1_case_timeline")(lambda t: tl.case_timeline(t.cases).withColumn(
    "conf", r6(c("conf"))))
query("tml_2_extended_timeline")(lambda t: tl.extended_timeline(
    t.cases, t.audit, t.messages).withColumn(
    "conf", r6(c("conf"))))

# ------------------------------------------------------------ streams


def _stream(t: Tables, name: str) -> DataFrame:
    # A file source follows a folder; the pattern also matches a table that is a single file.
    path = f"{t.folder.rstrip('/')}/{name}.parque[t]"
    return live.read_stream(t.spark, path, t.raw(name).schema)


@query("str_1_scored_stream")
def _scored_stream(t: Tables) -> DataFrame:
    customers = t.raw("customer").count()
    stream = ad.shape_messages(_stream(t, "documents"), F.lit(customers))
    return live.drain(live.score_stream(stream, t.profile, scorer, LEX), "scored-inbox")


def half_of_one(messages: DataFrame) -> DataFrame:
    """The same messages, every second one from one customer and one in ten from nobody."""
    number = F.substring("message_id", 2, 12).cast("bigint")
    return messages.withColumn("customer_id", F.when(number % 2 == 0, ad.customer_key(F.lit(1)))
                               .when(number % 10 == 1, NO_CUSTOMER)
                               .when(number % 10 == 3, F.lit(None)).otherwise(c("customer_id")))


@query("str_1_hot_customers")
def _hot_stream(t: Tables) -> DataFrame:
    customers = t.raw("customer").count()
    stream = ad.shape_messages(_stream(t, "documents"), F.lit(customers))
    return live.score_batches(half_of_one(stream), written(t.profile, "book"), "hot-inbox",
                              scorer, LEX)


@query("str_2_repeat_suppression")
def _repeat_suppression(t: Tables) -> DataFrame:
    """Three in four events deliver a message of their own, the others repeat one."""
    events = _stream(t, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        ad.message_key(F.when(c("event_id") % 4 == 3, F.floor(c("event_id") / 4) * 4)
                       .otherwise(c("event_id"))).alias("message_id"))
    kept = live.without_repeats(events, "ts", "60 days")
    return live.drain(kept, "first-seen").groupBy("message_id").agg(F.count("*").alias("kept"))


def _ledger(t: Tables) -> Ledger:
    """The audit stream taken in, every batch delivered twice."""
    ledger = Ledger(t.spark, shared_dir(t.spark, "ledger"))
    rows = ad.shape_audit(_stream(t, "events"), F.lit(t.raw("documents").count()))

    def twice(batch: DataFrame, number: int) -> None:
        ledger.keep(batch, number)
        ledger.keep(batch, number)

    rows.writeStream.foreachBatch(twice).option(
        "checkpointLocation", shared_dir(t.spark, "ledger-offsets")).trigger(
        availableNow=True).start().awaitTermination()
    return ledger


query("str_3_status_over_log")(lambda t: _ledger(t).status())
query("str_3_log_rows")(lambda t: _ledger(t).log().select(
    "seq", "timestamp", "type", "step", "message_id", "human_verdict", "fused_risk",
    "leaving_confirmed"))


def _dated_risk(events: DataFrame) -> DataFrame:
    """Logged risk with its time, from the event table."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        ad.customer_key(c("user_id")).alias("customer_id"),
        c("ts").cast("timestamp").alias("ts"), rk.band(k / 100.0).alias("risk_band"))


query("str_4_risk_trend")(lambda t: an.risk_trend(_dated_risk(t.raw("events"))).select(
    F.date_format("bucket", "yyyy-MM-dd").alias("day"), "customers"))


@query("str_4_risk_trend_stream")
def _trend_stream(t: Tables) -> DataFrame:
    return live.trend_table(_dated_risk(_stream(t, "events")), "risk-trend").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "customers", "is_final")
