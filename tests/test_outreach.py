import pytest
from conftest import by
from pyspark.sql import functions as F

from tidekeep.operators import outreach as og
from tidekeep.operators.listen import with_detected_language

LONG = "word " * 20


def plan(spark, rows, schema=""):
    return spark.createDataFrame(
        rows, "message_id string, action string, language string, offer_value_aed double,"
              " candidate string")


def test_templates_speak_their_language(spark):
    table = og.template_table(spark).filter("action <> 'human_triage'").withColumn(
        "text", og.fill(F.col("template"), F.lit(200.0)))
    rows = with_detected_language(table.select("action", "lang", "text")).collect()
    assert len(rows) == 32
    assert [(r.action, r.lang) for r in rows if r.language != r.lang] == []


def test_templates_pass_their_own_checks(spark):
    offers = {"fee_waiver": 200.0, "remittance_support": 100.0}
    rows = [(f"{a}/{lang}", a, lang, offers.get(a, 0.0), None)
            for a, t in og.TEMPLATES.items() for lang in t if a != "human_triage"]
    filled = og.with_template(plan(spark, rows)).withColumn("candidate", F.col("template_text"))
    checked = og.check_candidates(filled.drop("template_text", "template_language"))
    assert [(r.message_id, r.candidate_flags) for r in checked.collect()
            if r.candidate_flags or r.candidate_broken] == []


@pytest.mark.parametrize("candidate, action, offer, flags", [
    (LONG, "rm_call", 0.0, []),
    ("word " * 19, "rm_call", 0.0, ["too short"]),
    (LONG + "Act now, last chance", "rm_call", 0.0,
     ["urgent wording: act now", "urgent wording: last chance"]),
    (LONG + "[Name] {x} [] {y}", "rm_call", 0.0, ["open placeholders: [Name], {x}, []"]),
    (LONG + "[" + "x" * 41 + "]", "rm_call", 0.0, []),
    (LONG + "AED 200", "fee_waiver", 200.0, []),
    (LONG + "AED 200", "rm_call", 0.0, ["unapproved amounts: 200.0"]),
    (LONG + "AED 200 aed 1,500.5 AED 7 aed 7", "fee_waiver", 200.0,
     ["unapproved amounts: 7.0, 1500.5"]),
    (LONG + "please reconsider", "dignified_goodbye", 0.0, ["pressure to stay in a goodbye"]),
    (LONG + "please reconsider", "rm_call", 0.0, []),
    ("ang ng sa po ako " * 5, "rm_call", 0.0, ["wrong language: tl instead of en"]),
])
def test_guardrails(spark, candidate, action, offer, flags):
    row = og.serve(plan(spark, [("m", action, "en", offer, candidate)])).first()
    assert row.guardrail_flags == flags
    assert row.draft_source == ("template" if flags else "llm")
    assert (row.draft_message == candidate) == (not flags)


def test_serving(spark):
    got = by(og.serve(plan(spark, [
        ("triage", "human_triage", "tl", 0.0, LONG),
        ("absent", "rm_call", "hi", 0.0, None),
        ("foreign", "rm_call", "de", 0.0, "too short"),
        ("broken", "rm_call", "en", 0.0, "aed , act now"),
    ])), "message_id")
    assert got["triage"].draft_language == "en" and got["triage"].draft_source == "template"
    assert got["triage"].guardrail_flags == []
    assert got["absent"].draft_language == "hi" and got["absent"].guardrail_flags == []
    assert got["foreign"].draft_language == "en"  # no template in that language
    assert got["foreign"].guardrail_flags[0] == "too short"
    assert got["broken"].draft_source == "template" and got["broken"].guardrail_flags == []


def test_offer_is_filled_in(spark):
    got = by(og.with_template(plan(spark, [("a", "fee_waiver", "en", 200.0, None),
                                           ("q", "answer_query", "en", 0.0, None)])),
             "message_id", "template_text")
    assert "AED 200 " in got["a"] and og.QUERY_ANSWER in got["q"]


def test_prompt(spark):
    df = spark.createDataFrame(
        [("t", "fee_waiver", "hi", 200.0, "Fees_Charges", "High", ["r1", "r2"]),
         ("t", "human_triage", "hi", 0.0, "Fees_Charges", "High", ["r0"])],
        "text string, action string, language string, offer_value_aed double, issue_type string,"
        " risk_band string, rationale array<string>").coalesce(1)
    rows = og.with_prompt(df, tone="Warm").collect()
    assert "Hindi (romanized)" in rows[0].prompt_used and "AED 200" in rows[0].prompt_used
    assert "Tone: Warm" in rows[0].prompt_used and "Why: r1; r2" in rows[0].prompt_used
    assert rows[1].prompt_used is None


def test_every_prompt_has_the_rules(spark):
    rows = [("M1", "de"), ("M2", "en"), ("M3", None), ("M4", ""), ("M5", "zz")]
    plan = spark.createDataFrame(
        [(i, lang, "rm_call", 0.0, "text", "Fees_Charges", "High", ["why"]) for i, lang in rows],
        "message_id string, language string, action string, offer_value_aed double, text string,"
        " issue_type string, risk_band string, rationale array<string>")
    prompts = [r["prompt_used"] for r in og.with_prompt(plan).collect()]
    assert all(p.startswith(og.PROMPT_RULES.split("{language}")[0]) for p in prompts)
    assert "Use only de." in prompts[0] and "Use only English." in prompts[1]
    assert og.LANGUAGE_UNKNOWN in prompts[2] and og.LANGUAGE_UNKNOWN in prompts[3]
