import json

import pytest

from conftest import by
from pyspark.sql import functions as F

from tidekeep.operators import review as rv
from tidekeep.operators import timeline as tl
from tidekeep.plans import analytics as an
from tidekeep.schemas import AUDIT, DECISION_FIELDS, PENDING
from tidekeep.sources import files as fl


def log(spark, rows):
    names = [f.name for f in AUDIT.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], AUDIT)


ROWS = [
    dict(seq=1, timestamp="2024-01-01T00:00:00", message_id="m1", customer_id="A",
         human_verdict="Approved"),
    dict(seq=2, timestamp="2024-01-02T00:00:00", message_id="m1", customer_id="A",
         human_verdict="Rejected", reviewer_note="late"),
    dict(seq=3, timestamp="2024-01-02T00:00:00", message_id="m2", customer_id="Z",
         human_verdict="approved"),
    dict(seq=4, timestamp="2024-01-03T00:00:00", type="event", message_id="m1", step="Draft edited",
         actor="human_reviewer", summary="saved", status="ok"),
    dict(seq=5, timestamp="2024-01-03T00:00:00", message_id="m3", customer_id="A",
         human_verdict=""),
]


def test_latest_and_first(spark):
    audit = log(spark, ROWS)
    assert by(rv.latest_status(audit), "message_id", "status") == {
        "m1": "Rejected", "m2": "approved"}
    assert by(rv.first_verdict(audit), "message_id", "human_verdict") == {"m1": "Approved"}
    queue = spark.createDataFrame([("m1",), ("m9",)], "message_id string")
    assert by(rv.with_status(queue, rv.latest_status(audit)), "message_id", "status") == {
        "m1": "Rejected", "m9": PENDING}


def test_audit_view(spark):
    rows = by(rv.audit_view(log(spark, [
        *ROWS, dict(seq=6, actor="", summary="", status="", human_verdict="Approved",
                    issue_type="Fees_Charges", churn_signal="Low", risk_band="Low",
                    action="answer_query")])), "seq")
    assert rows[6].type == "decision" and rows[6].actor_or_verdict == "Approved"
    assert rows[6].summary == "Fees_Charges Low -> Low -> answer_query"
    assert rows[6].status == "Approved" and rows[6].timestamp == ""
    assert rows[4].type == "event" and rows[4].summary == "saved" and rows[4].customer == ""
    newest = rv.newest_first(rv.audit_view(log(spark, ROWS))).collect()
    assert [r.seq for r in newest] == [5, 4, 3, 2, 1]


def test_transitions(spark):
    cases = spark.createDataFrame(
        [(f"m{i}", "fee_waiver", "L", 200.0, "draft") for i in range(6)],
        "message_id string, action string, action_label string, offer_value_aed double,"
        " draft_message string")
    verdicts = spark.createDataFrame([
        ("m0", "Overridden", "n", "rm_call", None), ("m1", "Overridden", None, "own_code", ""),
        ("m2", "Dignified Goodbye", None, "rm_call", None), ("m3", "Rejected", None, None, "x"),
        ("m4", "Approved with edits", None, None, "edited"), ("m5", "Overridden", None, "", None),
    ], "message_id string, human_verdict string, reviewer_note string, override_action string,"
       " edited_message string")
    got = by(rv.apply_review(cases, verdicts), "message_id")
    assert (got["m0"].action, got["m0"].offer_value_aed) == ("rm_call", 200.0)  # offer is kept
    assert got["m1"].action_label == "own_code" and got["m1"].final_message == "draft"
    assert got["m2"].action == "dignified_goodbye"
    assert got["m3"].final_message == "" and got["m3"].status == "Rejected"
    assert got["m4"].final_message == "edited" and got["m4"].reviewer_note == ""
    assert got["m5"].action == "fee_waiver"


def test_rates_are_case_sensitive_and_flag(spark, profiles):
    rows = []
    for i in range(5):
        rows.append(dict(seq=i, message_id=f"a{i}", customer_id="A",
                         human_verdict="Rejected" if i < 2 else "approved"))
    for i in range(4):
        rows.append(dict(seq=10 + i, message_id=f"b{i}", customer_id="B",
                         human_verdict="Rejected"))
    for i in range(21):
        rows.append(dict(seq=20 + i, message_id=f"c{i}", customer_id="C",
                         human_verdict="Approved with edits"))
    stats = rv.review_stats(log(spark, rows), profiles)
    rates = by(an.review_rates(stats), "segment")
    assert rates["Mass"].approval_rate == 0.0 and rates["Mass"].rejection_rate == 0.4
    assert rates["Private"].approval_rate == 1.0
    flags = by(an.disproportion(stats), "segment", "flagged")
    assert flags == {"Mass": True, "Premium": False, "Private": False}  # 4 reviews never flag


def test_empty_log(spark, profiles, tmp_path):
    audit = fl.read_audit(spark, str(tmp_path / "none"))
    assert audit.count() == 0
    stats = rv.review_stats(audit, profiles)
    assert an.review_rates(stats).count() == 0 and an.disproportion(stats).count() == 0
    assert an.distribution(stats, "human_verdict").count() == 0


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    case = spark.createDataFrame([(0.12345, "m1", "C1")],
                                 "conf double, message_id string, customer_id string")
    fl.append_log(fl.event_rows(
        case, F.lit("case_analyzed"), F.lit("ai_system"), F.lit("s"), F.lit("2024-01-01T00:00:00"),
        confidence=F.col("conf"), extras={"message_id": F.col("message_id"),
                                          "batch": F.lit(7)}), path)
    decision = spark.createDataFrame([("m1", "Approved")], "message_id string, v string").select(
        *[F.lit(None).cast("string").alias(n) if n not in ("message_id", "human_verdict")
          else F.col("message_id") if n == "message_id" else F.col("v").alias("human_verdict")
          for n in DECISION_FIELDS])
    fl.append_log(decision, path)
    (tmp_path / "log" / "extra.json").write_text("\n\n" + json.dumps(
        {"message_id": "m2", "human_verdict": "Rejected"}) + "\n\n")
    rows = {(r.type, r.message_id): r for r in fl.read_audit(spark, path).collect()}
    assert set(rows) == {("event", "m1"), (None, "m1"), (None, "m2")}
    event = rows[("event", "m1")]
    assert event.confidence == 0.123 and event.extras == {"batch": "7"} and event.status == "ok"


def test_csv_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        'message_id,customer_id,text,language,issue_type,churn_signal\n'
        'M1,C1,"a, ""quoted"" text",en,Fees_Charges,Low\n', encoding="utf-8")
    assert fl.read_messages(spark, str(tmp_path / "m.csv")).first().text == 'a, "quoted" text'


def test_reports(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"note": "n", "m": {"held_out": {
        "n": 3, "issue_acc": 0.5, "per_language": {"en": {"n": 2}}}}, "matrix": [[1, 0], [0, 1]]},
        indent=1))
    rows = by(fl.read_report(spark, str(path), "bake"), "path", "value")
    assert rows["m.held_out.issue_acc"] == "0.5" and rows["m.held_out.per_language.en.n"] == "2"
    assert rows["matrix"] == "[[1,0],[0,1]]"
    report = fl.read_report(spark, str(path), "bake")
    assert fl.metric_value(report, "m.held_out.issue_acc").first().value == 0.5
    assert fl.read_report(spark, str(tmp_path / "no.json"), "x").count() == 0


def test_timeline(spark):
    case = spark.createDataFrame(
        [("m1", "A", "hello", "en", 0.9, "Fees_Charges", 0.7, "Low", 0.6, "heuristic",
          ([5.0], ["tomorrow"], None, None), 0.345, True, 0.343, "Low", "fee_waiver", "template",
          "en", ["f"], "d")],
        "message_id string, customer_id string, text string, language string,"
        " language_confidence double, issue_type string, issue_confidence double,"
        " churn_signal string, churn_signal_confidence double, classifier string,"
        " entities struct<amounts_aed:array<double>,dates:array<string>,"
        "destinations:array<string>,products:array<string>>, behaviour_score double,"
        " profile_found boolean, fused_risk double, risk_band string, action string,"
        " draft_source string, draft_language string, guardrail_flags array<string>,"
        " draft_message string")
    steps = {r.step_no: r for r in tl.case_timeline(case).collect()}
    assert len(steps) == 9 and steps[1].summary == "5 chars, customer A"
    assert steps[5].summary == "amounts_aed: 5.0; dates: tomorrow"
    assert steps[6].summary == f"P(churn) = {0.345:.0%}"
    assert steps[9].summary == "template in en, flags: 1" and steps[2].conf == 0.9
    assert tl.case_timeline(case.drop("draft_message")).count() == 8
    audit = log(spark, ROWS)
    longer = tl.extended_timeline(case, audit).orderBy(
        F.col("timestamp").asc_nulls_first(), "seq", "part").collect()
    assert [r.step for r in longer[9:]] == ["Human reviewed", "Final decision logged"] * 2 + [
        "Draft edited"]
    assert longer[11].summary == 'Rejected - "late"'


def test_report_of_any_depth_keeps_null_leaves(spark, tmp_path):
    path = tmp_path / "deep.json"
    path.write_text('{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":1}}}}}}},"x":null,"o":{},"l":[1,2]}')
    rows = by(fl.read_report(spark, str(path), "deep"), "path", "value")
    assert rows == {"a.b.c.d.e.f.g.h": "1", "x": None, "o": "{}", "l": "[1,2]"}


def test_report_strings_that_look_like_objects(spark, tmp_path):
    path = tmp_path / "odd.json"
    path.write_text(r'''{"a":"{not json","e":"{\"x\":1}","n":{"s":" {} ","t":true,"f":0.5},"k":"[1"}''')
    rows = by(fl.read_report(spark, str(path), "odd"), "path", "value")
    assert rows == {"a": "{not json", "e": '{"x":1}', "n.s": " {} ", "n.t": "true", "n.f": "0.5",
                    "k": "[1"}
    for text in ("", "[1,2]", "no json", "{}", "null"):
        path.write_text(text)
        assert fl.read_report(spark, str(path), "odd").count() == 0


def test_csv_with_line_breaks_and_any_column_order(spark, tmp_path):
    path = tmp_path / "messages.csv"
    path.write_text('text,message_id,churn_signal,customer_id,language,issue_type\n'
                    '"first, line\nsecond ""line""",M1,High,C1,en,Fees_Charges\n')
    row = fl.read_messages(spark, str(path)).collect()[0]
    assert row.asDict() == {"message_id": "M1", "customer_id": "C1", "language": "en",
                            "text": 'first, line\nsecond "line"', "issue_type": "Fees_Charges",
                            "churn_signal": "High"}


def test_csv_row_that_does_not_fit_fails(spark, tmp_path):
    from tidekeep.schemas import PROFILE
    path = tmp_path / "customers.csv"
    names = [f.name for f in PROFILE.fields]
    path.write_text(",".join(names) + "\n" + ",".join("x" for _ in names) + "\n")
    with pytest.raises(Exception):
        fl.read_profiles(spark, str(path)).collect()
