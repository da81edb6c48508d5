import random

import pytest
from conftest import by
from pyspark.sql import functions as F

from tidekeep.functions import numeric as nm
from tidekeep.functions import risk as rk
from tidekeep.operators.assess import assess, fixed_scorer, guard_features, score_book


def signals(spark, rows):
    return spark.createDataFrame(
        rows, "message_id string, customer_id string, issue_type string, issue_confidence double,"
              " churn_signal string, churn_signal_confidence double, leaving_confirmed boolean")


def constant(value):
    return lambda profile: profile.withColumn("behaviour", F.lit(value))


@pytest.mark.parametrize("behaviour, signal, leaving, fused, band", [
    (0.5, "Low", False, 0.343, "Low"),      # 0.55*0.5 + 0.45*0.15 lies just above the tie
    (0.5, "Medium", False, 0.523, "Medium"),
    (0.5, "High", False, 0.68, "High"),
    (0.5, "High", True, 0.85, "Critical"),
    (0.0, "High", True, 0.85, "Critical"),
    (1.0, "High", False, 0.955, "Critical"),
    (1.0, "Low", False, round(0.55 + 0.45 * 0.15, 3), "High"),
    (0.0, "Low", False, round(0.45 * 0.15, 3), "Low"),
])
def test_fusion_table(spark, profiles, behaviour, signal, leaving, fused, band):
    row = assess(signals(spark, [("m", "A", "Fees_Charges", 0.7, signal, 0.7, leaving)]),
                 profiles, constant(behaviour)).first()
    assert row.fused_risk == fused and row.risk_band == band
    assert row.behaviour_score == behaviour and row.profile_found


def test_band_edges_and_unrounded_banding(spark):
    values = [0.75, 0.7499, 0.55, 0.5499, 0.35, 0.3499]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.b for r in df.select(rk.band(F.col("v")).alias("b")).collect()]
    assert got == ["Critical", "High", "High", "Medium", "Medium", "Low"]


def test_rounding_matches_binary_value(spark):
    rng = random.Random(5)
    values = [0.3425, 0.5225000000000001, 0.6665, 0.0005, 0.0015, 0.1235, 0.9995, 1.0, 0.0]
    values += [round(rng.random(), 4) for _ in range(400)] + [rng.random() for _ in range(400)]
    values += [0.55 * 0.5 + 0.45 * t for t in (0.15, 0.55, 0.9)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [tuple(r) for r in df.select(nm.round_exact(F.col("v"), 3), nm.fixed2(F.col("v")),
                                       nm.percent(F.col("v"))).collect()]
    assert got == [(round(v, 3), f"{v:.2f}", f"{v:.0%}") for v in values]


def test_reasons_in_order_and_cut_to_five(spark, profiles):
    msgs = signals(spark, [("lv", "B", "x", 0.7, "High", 0.7, True),
                           ("hi", "B", "x", 0.7, "High", 0.7, False),
                           ("lo", "B", "x", 0.7, "Low", 0.7, False),
                           ("edge", "C", "x", 0.7, "Low", 0.7, False),
                           ("none", "Z", "x", 0.7, "High", 0.7, False),
                           ("null", None, "x", 0.7, "Low", 0.7, False)])
    got = by(assess(msgs, profiles, constant(0.5)), "message_id")
    assert got["lo"].reasons == [
        "balance moved -30% in three months", "salary no longer arrives",
        "unusual foreign transfers", "3 complaints in half a year",
        "branch visits dropping fast"]
    assert got["lv"].reasons[0] == rk.STATES_LEAVING and len(got["lv"].reasons) == 5
    assert got["hi"].reasons[0] == rk.HIGH_INTENT
    assert got["edge"].reasons == []  # every threshold is strict where it must be
    assert got["none"].reasons == [rk.HIGH_INTENT, rk.NO_PROFILE]
    assert (got["none"].segment, got["none"].clv_estimate_aed, got["none"].profile_found) == (
        "Unknown", 0.0, False)
    assert got["null"].behaviour_score == 0.5


def test_no_model_means_prior_and_note(spark, profiles):
    row = assess(signals(spark, [("m", "B", "x", 0.7, "Low", 0.7, False)]), profiles).first()
    assert row.behaviour_score == 0.5 and row.reasons == [rk.NO_PROFILE]
    assert row.profile_found and row.segment == "Premium" and not row.model_available


def test_triage_edge(spark, profiles):
    msgs = signals(spark, [("a", "A", "x", 0.5, "Low", 0.5, False),
                           ("b", "A", "x", 0.49, "Low", 0.9, False),
                           ("c", "A", "x", 0.9, "Low", 0.49, False)])
    got = by(assess(msgs, profiles), "message_id", "needs_human_triage")
    assert got == {"a": False, "b": True, "c": True}


def test_reviewer_checklist(spark):
    df = spark.createDataFrame(
        [(False, False, 0.5, 0.5, 10.0), (True, True, 0.34, 0.9, 100000.0),
         (False, False, 0.75, 0.15, 0.0), (False, False, 0.35, 0.9, 99999.0)],
        "needs_human_triage boolean, leaving_confirmed boolean, behaviour_score double,"
        " text_score double, clv_estimate_aed double").coalesce(1)
    got = [r[0] for r in df.select(rk.reviewer_checklist()).collect()]
    assert got == [["nothing_unusual"],
                   ["read_original", "verify_relocation", "calm_behaviour_alarming_text",
                    "high_value"], ["quiet_high_risk"], ["nothing_unusual"]]


def test_audit_only_column_is_refused():
    with pytest.raises(ValueError):
        guard_features(["segment", "nationality_region"])


def test_fixed_scorer(spark, profiles):
    book = score_book(profiles, lambda p: fixed_scorer(p, 0.0, {"complaints_6m": 1.0}))
    got = by(book, "customer_id", "behaviour_risk")
    assert got["A"] == 0.5 and got["B"] == pytest.approx(0.952574)
