"""Retention tables derived from a general order/event/document schema.

Every view is computed from whole tables. Money is summed as decimals, so results do not depend
on the order in which partitions are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.literal import lookup
from ..schemas import ISSUES, LANGUAGES, SIGNALS

ORDERS_UNTIL = "2001-08-01"
LAST_YEAR = "2000-08-01"
YEAR_BEFORE = "1999-08-01"
EVENTS_FROM, EVENTS_HALF, EVENTS_WEEK = "2024-01-01", "2024-01-16", "2024-01-24"

# Score used where results must be reproducible: intercept and weights, chosen by hand.
FIXED_INTERCEPT = 0.4
FIXED_WEIGHTS = {"balance_trend_3m": -1.8, "salary_credit_active": -0.8,
                 "intl_transfer_spike": 0.7, "complaints_6m": 0.2}

# Closing lines: what the writer of a document from a source wants, with the declared labels.
CLOSINGS = {
    "src0": ("Our family is leaving the UAE in June: kindly close my account by then, next month "
             "at the latest.", "Account_Closure", "High"),
    "src1": ("قررت أنني سأغادر الإمارات بعد العيد، ولم يصل رمز التحقق إلى هاتفي الشهر القادم.",
             "App_Technical", "High"),
    "src2": ("aalis na ako ng UAE ngayong taon kaya isara ninyo ang lahat, salamat po.",
             "Account_Closure", "High"),
    "src3": ("hum hamesha ke liye ja rahe, baaki paise India bhejne ka tareeka bataiye.",
             "Remittance_Transfer", "High"),
    "src4": ("Frustrated: a fee nobody announced, AED 1,250.50, is on the bill.",
             "Fees_Charges", "Medium"),
    "src5": ("Twice this month a shop refused the card, the terminal said declined.",
             "Card_Services", "Medium"),
    "src6": ("Would 500,000 dirhams be too much for a mortgage? We are not sure we want one.",
             "Loan_Mortgage", "Medium"),
    "src7": ("Frustrated again, dhs. 300 for Pakistan and AED 20 for Egypt: neither transfer came.",
             "Remittance_Transfer", "Medium"),
    "src8": ("First a crash of the app, then the otp got lost.", "App_Technical", "Medium"),
    "src9": ("Is the branch by the harbour open tomorrow?", "General_Query", "Low"),
    "src10": ("dismayado na talaga ako sa singil na ito po.", "Fees_Charges", "Medium"),
    "src11": ("itna charge lage to pareshan kaun na ho, bataiye.", "Fees_Charges", "Medium"),
    "src12": ("هذه الرسوم كثيرة وأنا محبط جدا.", "Fees_Charges", "Medium"),
    "src13": ("With the loan still open: we are relocating in spring.", "Loan_Mortgage", "High"),
    "src14": ("Mail the statements that show AED , by next week.", "App_Technical", "Low"),
    "src15": ("As of Sunday I have already resigned; please shut the salary account.",
              "Account_Closure", "High"),
    "src16": ("A remittance hangs since Monday, block or no block, I am uncertain.",
              "Remittance_Transfer", "Medium"),
    "src17": ("pata nahi AED ५०० ki fee kab lage, aed १,२५०.५ bhi dikha.", "Fees_Charges", "Low"),
}

# Closing lines of machine-written drafts, for the checks on candidate texts.
DRAFT_CLOSINGS = {
    "src0": "act now, this is your last chance and it expires soon",
    "src1": "Dear [Customer Name], {bank} and [Your Full Name] and [x]",
    "src2": "we give you AED 200 back",
    "src3": "we give you AED 200 or AED 1,500.75 and aed 100",
    "src4": "please stay with us, a special offer waits",
    "src5": "salamat po, gusto kong ipadala ang pera sa oras na ito",
    "src6": "AED , is credited",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def customer_key(number: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(number.cast("string"), 12, "0"))


def message_key(number: Column) -> Column:
    return F.concat(F.lit("M"), F.lpad(number.cast("string"), 12, "0"))


def _order_features(orders: DataFrame) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    price = _cents("o_totalprice")

    def spent(low: str, high: str | None = None) -> Column:
        inside = day >= F.lit(low).cast("date")
        if high:
            inside = inside & (day < F.lit(high).cast("date"))
        return F.coalesce(F.sum(F.when(inside, price)), F.lit(0).cast("decimal(28,2)"))

    # count(distinct) over five priorities as a set of flags keeps the aggregation one-stage.
    return orders.groupBy("o_custkey").agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.size(F.collect_set("o_orderpriority")).alias("kinds"),
        F.sum(price).cast("double").alias("spend"), F.count("*").alias("n_orders"),
        spent(LAST_YEAR).cast("double").alias("spend_recent"),
        spent(YEAR_BEFORE, LAST_YEAR).cast("double").alias("spend_prior"))


def _event_features(events: DataFrame) -> DataFrame:
    day = F.col("ts").cast("date")

    def since(start: str) -> Column:
        return day >= F.lit(start).cast("date")

    kind, amount = F.col("event_type"), _cents("value")
    zero = F.lit(0).cast("decimal(28,2)")
    return events.groupBy("user_id").agg(
        F.count_if((kind == "purchase") & since(EVENTS_WEEK)).alias("week_purchases"),
        F.count_if((kind == "purchase") & since(EVENTS_HALF)).alias("half_purchases"),
        F.count_if((kind == "error") & since(EVENTS_HALF)).alias("half_errors"),
        F.count_if((kind == "view") & since(EVENTS_HALF)).alias("views_late"),
        F.count_if((kind == "view") & ~since(EVENTS_HALF)).alias("views_early"),
        F.coalesce(F.sum(F.when(since(EVENTS_WEEK), amount)), zero).cast("double")
        .alias("value_week"),
        F.coalesce(F.sum(F.when(~since(EVENTS_WEEK), amount)), zero).cast("double")
        .alias("value_before"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer in the profile contract."""
    c = F.col
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
              .join(nations, c("c_nationkey") == c("n_nationkey"), "left")
              .join(regions, c("n_regionkey") == c("r_regionkey"), "left")
              .join(_order_features(table(spark, sf_dir, "orders")),
                    c("c_custkey") == c("o_custkey"), "left")
              .join(_event_features(table(spark, sf_dir, "events")),
                    c("c_custkey") == c("user_id"), "left"))
    until = F.lit(ORDERS_UNTIL).cast("date")
    first = F.coalesce("first_day", until)
    months = ((F.year(until) - F.year(first)) * 12 + F.month(until) - F.month(first))
    spend = F.coalesce("spend", F.lit(0.0))
    prior = F.coalesce("spend_prior", F.lit(0.0))
    early = F.coalesce("views_early", F.lit(0))
    late = F.coalesce("views_late", F.lit(0))
    return joined.select(
        customer_key(c("c_custkey")).alias("customer_id"),
        c("r_name").alias("nationality_region"),
        months.cast("int").alias("tenure_months"),
        F.when(c("c_acctbal") < 5000, "Mass").when(c("c_acctbal") < 9000, "Premium")
        .otherwise("Private").alias("segment"),
        F.coalesce("kinds", F.lit(0)).alias("products_held"),
        F.coalesce(c("spend") / c("n_orders"), F.lit(0.0)).alias("avg_balance_aed"),
        F.when(prior == 0, 0.0).otherwise((F.coalesce("spend_recent", F.lit(0.0)) - prior)
                                          / F.greatest(prior, F.lit(0.01)))
        .alias("balance_trend_3m"),
        F.when(c("user_id").isNull(), True).otherwise(c("week_purchases") > 0)
        .alias("salary_credit_active"),
        F.coalesce("half_purchases", F.lit(0)).cast("int").alias("remittance_count_3m"),
        F.coalesce(c("value_week") > 1.5 * (c("value_before") / 23.0 * 7.0), F.lit(False))
        .alias("intl_transfer_spike"),
        F.coalesce("half_errors", F.lit(0)).cast("int").alias("complaints_6m"),
        F.when(early == 0, 0.0).otherwise((late - early).cast("double")
                                          / F.greatest(early, F.lit(1)).cast("double"))
        .alias("branch_visits_trend"),
        F.floor(spend * 0.005).cast("int").alias("clv_estimate_aed"),
        F.coalesce(c("last_day") < F.lit(LAST_YEAR).cast("date"), F.lit(True)).alias("churned"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per document: its whole text plus the closing line of its source.

    A quarter of the assigned customer numbers lie beyond the customer table, so some messages
    have no profile.
    """
    documents = table(spark, sf_dir, "documents")
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("n")).scalar()
    return shape_messages(documents, customers)


def shape_messages(documents: DataFrame, customers: Column) -> DataFrame:
    pool = F.floor(customers * 4 / 3).cast("bigint")
    closing = {s: v[0] for s, v in CLOSINGS.items()}
    issue = {s: v[1] for s, v in CLOSINGS.items()}
    signal = {s: v[2] for s, v in CLOSINGS.items()}
    source = F.col("source")
    return documents.select(
        message_key(F.col("doc_id")).alias("message_id"),
        customer_key(F.pmod(F.col("doc_id") * 7, pool)).alias("customer_id"),
        F.concat_ws(" ", "text", lookup(source, closing)).alias("text"),
        F.col("lang").alias("language"),
        F.coalesce(lookup(source, issue), F.lit("General_Query")).alias("issue_type"),
        F.coalesce(lookup(source, signal), F.lit("Low")).alias("churn_signal"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft texts as an external generator would deliver them, keyed by message; one source
    delivers none."""
    return table(spark, sf_dir, "documents").select(
        message_key(F.col("doc_id")).alias("message_id"),
        F.when(F.col("source") != "src7", F.concat_ws(
            " ", "text", lookup(F.col("source"), DRAFT_CLOSINGS))).alias("candidate"))


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw user turns with untidy ids, for the input checks."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return shape_inbox(turns)


def shape_inbox(turns: DataFrame) -> DataFrame:
    """Ids and texts between blanks of several kinds; some ids and texts are nothing but blanks."""
    turn = F.col("turn")
    return turns.select(
        F.when(F.pmod("turn", F.lit(4)) == 2, " \t ").otherwise(
            F.concat(F.lit("\tT"), F.col("conv_id").cast("string"), F.lit("-"),
                     turn.cast("string"), F.lit(" \r"))).alias("message_id"),
        F.when(turn == 0, customer_key(F.col("conv_id"))).when(turn == 4, "\t")
        .alias("customer_id"),
        F.when((turn == 6) & (F.pmod("conv_id", F.lit(2)) == 0), "\n\t\u00a0").otherwise(
            F.concat(F.lit(" \n\u2003"), F.col("text"), F.lit("\t \n"))).alias("text"),
        F.when(F.pmod("conv_id", F.lit(3)) == 0, "ar")
        .when(F.pmod("conv_id", F.lit(3)) == 1, "auto").alias("lang_override"))


# Closing lines that no document has: (text, language, issue, signal).
UNSEEN_CLOSINGS = [
    ("After this summer we live elsewhere for good, so end my banking with you.", "en",
     "Account_Closure", "High"),
    ("My wire to my sister has not shown up on her side.", "en", "Remittance_Transfer", "Low"),
    ("We wonder whether to repay the house loan early, undecided so far.", "en", "Loan_Mortgage",
     "Medium"),
    ("A charge of AED 75 appeared twice and I am frustrated.", "en", "Fees_Charges", "Medium"),
    ("Please block the card, the shop kept it.", "en", "Card_Services", "Low"),
    ("The app shows a blank page and no otp arrives.", "en", "App_Technical", "Low"),
    ("When does the office close on Fridays?", "en", "General_Query", "Low"),
    ("سأغادر الإمارات نهائيا وأريد إغلاق الحساب.", "ar", "Account_Closure", "High"),
    ("لماذا هذه الرسوم على حسابي؟", "ar", "Fees_Charges", "Low"),
    ("hamesha ke liye ja rahe hain, khata band kar dijiye.", "hi", "Account_Closure", "High"),
    ("card kaam nahi karta, naya chahiye.", "hi", "Card_Services", "Low"),
    ("aalis na ako ng UAE sa Marso, pakisara ang account.", "tl", "Account_Closure", "High"),
    ("hindi ko mabuksan ang app mula kahapon po.", "tl", "App_Technical", "Low"),
]


def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second labelled message set: user turns of conversations, which share neither texts nor
    closing lines with the documents."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    line = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(UNSEEN_CLOSINGS))) + 1

    def part(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(x[k]) for x in UNSEEN_CLOSINGS]), line.cast("int"))
    return turns.select(
        F.concat(F.lit("U"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("message_id"),
        F.concat_ws(" ", "text", part(0)).alias("text"), part(1).alias("language"),
        part(2).alias("issue_type"), part(3).alias("churn_signal"))


AUDIT_ACTIONS = ["dignified_goodbye", "fee_waiver", "remittance_support",
                 "loan_restructure_info", "rm_call", "service_fix", "proactive_checkin",
                 "answer_query", "human_triage"]


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows from events: clicks are pipeline events, the rest are verdicts. Only even
    message numbers are reviewed."""
    events = table(spark, sf_dir, "events")
    documents = table(spark, sf_dir, "documents").agg(F.count("*").alias("n")).scalar()
    return shape_audit(events, documents)


def shape_audit(events: DataFrame, documents: Column) -> DataFrame:
    c = F.col
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select(
        c("event_id").alias("seq"), c("ts"), c("event_type"), c("value"), "user_id",
        (F.pmod("event_id", documents) * 2).alias("number"), k.alias("k"))
    is_event = c("event_type") == "click"
    high = c("value") > 30
    verdict = (F.when((c("event_type") == "purchase") & high, "Approved with edits")
               .when(c("event_type") == "purchase", "Approved")
               .when(c("event_type") == "view", "Overridden")
               .when(c("event_type") == "error", "Rejected")
               .when((c("event_type") == "signup") & high, "Dignified Goodbye")
               .when(c("event_type") == "signup", "Escalated"))

    def of(values: list[str], shift: int = 0) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]),
                            F.pmod(c("k") + shift, F.lit(len(values))) + 1)

    def decision(value: Column) -> Column:
        return F.when(~is_event, value)

    band = (F.when(c("k") >= 75, "Critical").when(c("k") >= 55, "High")
            .when(c("k") >= 35, "Medium").otherwise("Low"))
    return base.select(
        "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(is_event, "event").alias("type"),
        F.when(is_event, F.when(c("k") % 2 == 0, "Outreach re-drafted")
               .otherwise("Draft edited")).alias("step"),
        F.when(is_event, F.when(c("k") % 2 == 0, "ai_system").otherwise("human_reviewer"))
        .alias("actor"),
        F.when(is_event, F.concat(F.lit("event of value "), F.floor("value").cast("string")))
        .alias("summary"),
        F.when(is_event, "ok").alias("status"),
        F.when(is_event, c("k") / 100.0).alias("confidence"),
        message_key(c("number")).alias("message_id"),
        customer_key(c("user_id")).alias("customer_id"),
        decision(of(LANGUAGES)).alias("language"), decision(of(ISSUES)).alias("issue_type"),
        decision(of(SIGNALS)).alias("churn_signal"),
        decision(c("k") >= 90).alias("leaving_confirmed"),
        decision(c("k") / 100.0).alias("fused_risk"), decision(band).alias("risk_band"),
        decision(of(AUDIT_ACTIONS)).alias("action"),
        decision(F.when(of(AUDIT_ACTIONS) == "fee_waiver", 200.0).otherwise(0.0))
        .alias("offer_value_aed"),
        decision(F.lit("template")).alias("draft_source"),
        verdict.alias("human_verdict"),
        F.when(verdict.isNotNull() & (c("k") % 5 == 0), "second look").alias("reviewer_note"),
        F.when(verdict == "Overridden", of(AUDIT_ACTIONS, 1)).alias("override_action"))
