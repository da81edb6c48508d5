"""Aggregates over the scored book, the inbox, the queue and the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk as rk
from ..functions.numeric import round_scaled
from ..operators.literal import literal_table
from ..schemas import BANDS, SEGMENTS



def at_risk() -> Column:
    return F.col("behaviour_risk") >= rk.AT_RISK


def over_domain(grouped: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of a small aggregate in a fixed order; absent values stay, with nulls."""
    domain = literal_table(grouped.sparkSession, ["position", key],
                           [(i, v) for i, v in enumerate(values)])
    return domain.join(grouped, key, "left").orderBy("position")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count per value, most frequent first, ties by label."""
    return (df.groupBy(column).agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), F.col(column)))


def mean_risk_by_segment(book: DataFrame) -> DataFrame:
    means = book.groupBy("segment").agg(F.avg("behaviour_risk").alias("mean_risk"))
    return over_domain(means, "segment", SEGMENTS)


def signal_distribution(messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("churn_signal").agg(F.count("*").alias("n"))
    return over_domain(counts, "churn_signal", ["Low", "Medium", "High"])


def driver_counts(book: DataFrame) -> DataFrame:
    """How many at-risk customers each rule applies to: one pass, then seven values unpivoted."""
    tests = rk.rule_tests()
    sums = book.filter(at_risk()).agg(*[
        F.count_if(test).alias(feature) for feature, _, test in tests])
    rows = sums.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("driver"), F.col(feature).alias("n"))
        for feature, label, _ in tests])))
    return rows.filter("n > 0").orderBy("n", "driver")


def mean_clv_by_band(book: DataFrame) -> DataFrame:
    means = book.groupBy("band").agg(F.avg("clv_estimate_aed").alias("mean_clv"))
    return over_domain(means, "band", BANDS)


def review_rates(stats: DataFrame) -> DataFrame:
    verdict = F.col("human_verdict")

    def rate(test: Column) -> Column:
        return F.avg(test.cast("double"))
    return stats.groupBy("segment").agg(
        F.count("*").alias("reviews"), rate(verdict.startswith("Approved")).alias("approval_rate"),
        rate(verdict == "Overridden").alias("override_rate"),
        rate(verdict == "Rejected").alias("rejection_rate"))


def disproportion(stats: DataFrame) -> DataFrame:
    """Segments rejected well above the overall rate. The overall rate comes from the segment
    counts, so the log is aggregated once."""
    per = stats.groupBy("segment").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("human_verdict") == "Rejected").alias("rejected"))
    total = per.agg((F.sum("rejected").cast("double") / F.sum("n")).alias("rate"))
    rate = F.col("rejected").cast("double") / F.col("n")
    with_rates = per.select("segment", "n", rate.alias("rejection_rate"),
                            F.coalesce(total.scalar(), F.lit(0.0)).alias("overall_rate"))
    return with_rates.withColumn(
        "flagged", (F.col("n") >= 5) & (F.col("rejection_rate") > F.greatest(
            F.lit(0.15), F.col("overall_rate") * 1.5)))


def segment_distribution(book: DataFrame) -> DataFrame:
    return book.groupBy("segment").agg(
        F.count("customer_id").alias("customers"), F.avg("behaviour_risk").alias("mean_risk"),
        F.count_if(at_risk()).alias("at_risk"))


def region_audit(book: DataFrame) -> DataFrame:
    """Predicted against actual churn per region; the only use of the region column."""
    return book.groupBy("nationality_region").agg(
        F.count("customer_id").alias("customers"),
        F.avg("behaviour_risk").alias("mean_predicted_risk"),
        F.avg(F.col("churned").cast("double")).alias("actual_churn_rate")).orderBy(
        "nationality_region")


def exposure_by_segment(book: DataFrame) -> DataFrame:
    return book.filter(at_risk()).groupBy("segment").agg(
        F.count("*").alias("at_risk"), F.sum("clv_estimate_aed").alias("clv_at_risk"))


def book_kpis(book: DataFrame) -> DataFrame:
    clv = F.col("clv_estimate_aed")
    exposed = F.coalesce(F.sum(F.when(at_risk(), clv)), F.lit(0))
    return book.agg(
        F.count("*").alias("customers"), F.sum(clv).alias("total_clv"),
        F.count_if(at_risk()).alias("at_risk"), exposed.alias("clv_at_risk"),
        F.try_divide(exposed.cast("double"), F.sum(clv).cast("double")).alias("share_at_risk"))


def inbox_kpis(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count("*").alias("messages"),
        F.avg((F.col("language") != "en").cast("double")).alias("non_english_share"),
        F.count_if(F.col("churn_signal") == "High").alias("high_intent"))


def overview(book: DataFrame, messages: DataFrame) -> DataFrame:
    """Both one-row KPI sets as one row; the inbox part is a scalar subquery, not a join."""
    inbox = inbox_kpis(messages)
    part = inbox.select(F.struct(*inbox.columns).alias("inbox")).scalar()
    return book_kpis(book).withColumn("_inbox", part).select("*", "_inbox.*").drop("_inbox")


def segment_view(book: DataFrame) -> DataFrame:
    return book.groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        round_scaled(F.avg("behaviour_risk"), 3).alias("mean_risk"),
        F.count_if(at_risk()).alias("at_risk"),
        F.rint(F.coalesce(F.sum(F.when(at_risk(), F.col("clv_estimate_aed"))), F.lit(0))
               .cast("double")).alias("clv_at_risk_aed"))


def value_concentration(book: DataFrame) -> DataFrame:
    top = at_risk() & F.col("segment").isin("Premium", "Private")
    clv = F.col("clv_estimate_aed")
    return book.agg(
        F.count_if(top).alias("top_customers"),
        F.coalesce(F.sum(F.when(top, clv)), F.lit(0)).alias("top_clv_at_risk"),
        F.coalesce(F.try_divide(F.sum(F.when(top, clv)).cast("double"),
                                F.sum(F.when(at_risk(), clv)).cast("double")), F.lit(0.0))
        .alias("top_share"))


def segment_plays(book: DataFrame) -> DataFrame:
    clv = F.col("clv_estimate_aed")
    return book.groupBy("segment").agg(
        F.count("*").alias("customers"), F.avg(clv).alias("mean_clv"),
        F.count_if(at_risk()).alias("at_risk"),
        F.coalesce(F.sum(F.when(at_risk(), clv)), F.lit(0)).alias("clv_at_risk"))


def churn_base_rate(profile: DataFrame) -> DataFrame:
    churned = F.col("churned")
    return profile.agg(F.count_if(churned).alias("churned"), F.count("*").alias("customers"),
                       F.avg(churned.cast("double")).alias("base_rate"))


def calm_leavers(messages: DataFrame, book: DataFrame) -> DataFrame:
    """Messages with high intent whose customer's behaviour gives no warning."""
    high = messages.filter(F.col("churn_signal") == "High").select("message_id", "customer_id")
    joined = high.join(book.select("customer_id", "behaviour_risk"), "customer_id", "left")
    calm = F.coalesce(F.col("behaviour_risk") < 0.35, F.lit(False))
    return joined.agg(F.count("*").alias("high_messages"), F.count_if(calm).alias("calm"),
                      F.avg(calm.cast("double")).alias("calm_share"))


def risk_trend(cases: DataFrame, time: str = "ts", bucket: str = "day") -> DataFrame:
    """Distinct customers seen at high or critical risk per time bucket."""
    return (cases.filter(F.col("risk_band").isin("High", "Critical"))
            .groupBy(F.date_trunc(bucket, F.col(time)).alias("bucket"))
            .agg(F.countDistinct("customer_id").alias("customers")))


