"""SQL functions and views against the DataFrame expressions."""
from itertools import product

from pyspark.sql import functions as F

from tidekeep.functions import risk as rk
from tidekeep.functions import text as tx
from tidekeep.lexicon import EUROPEAN
from tidekeep.operators.decide import rule_id
from tidekeep.plans.queue import build_queue
from tidekeep.plans.sql_surface import register

MESSAGES = "message_id string, customer_id string, text string, language string"


def inbox(spark):
    words = [w for _, ws in EUROPEAN.issues for w in ws] + list(EUROPEAN.leaving) + list(
        EUROPEAN.wavering)
    rows = [(f"m{i}", "ABCZ"[i % 4], f"Hello, IT is {w.upper()}!", "en")
            for i, w in enumerate(words)] + [("n1", "A", None, "en"), ("n2", None, "", "en")]
    return spark.createDataFrame(rows, MESSAGES)


def test_functions_equal_the_expressions(spark, profiles):
    messages = inbox(spark)
    register(spark, messages, profiles, None, EUROPEAN)
    low = F.lower("text")
    leaving = tx.leaving_confirmed(low, EUROPEAN)
    want = messages.select("message_id", tx.keyword_issue(low, EUROPEAN),
                           tx.keyword_signal(leaving, low, EUROPEAN), leaving)
    got = spark.sql("SELECT message_id, keyword_issue(text), churn_intent(text),"
                    " says_leaving(text) FROM inbox")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()),
                                                                key=repr)
    cells = list(product([False, True, None], [False, True], ["Critical", "High", "Medium", "Low"],
                         ["Fees_Charges", "Remittance_Transfer", "Loan_Mortgage", "App_Technical",
                          "General_Query"], ["Mass", "Private"], [0.0, 5000.0, 9999.0, 10000.0]))
    grid = spark.createDataFrame(cells, "needs_human_triage boolean, leaving_confirmed boolean,"
                                 " risk_band string, issue_type string, segment string,"
                                 " clv_estimate_aed double")
    other = grid.select(rule_id().alias("a"), F.expr(
        "decision_rule(needs_human_triage, leaving_confirmed, risk_band, issue_type, segment,"
        " clv_estimate_aed)").alias("b")).filter("NOT a <=> b")
    assert other.count() == 0
    risks = spark.createDataFrame([(x, s, v) for x in (None, 0.0, 0.31, 0.7499, 0.75, 1.0)
                                   for s in ("High", "Medium", "Low", "?") for v in (True, False)],
                                  "behaviour double, signal string, leaving boolean")
    mixed = rk.with_leaving_floor(rk.mix(F.coalesce("behaviour", F.lit(rk.NEUTRAL_PRIOR)),
                                         rk.text_score(F.col("signal"))), F.col("leaving"))
    both = risks.select(mixed.alias("a"), F.expr("behaviour_mix(behaviour, signal, leaving)")
                        .alias("b")).select("a", "b", rk.band(F.col("a")).alias("x"),
                                            F.expr("risk_band(b)").alias("y"))
    assert both.filter("NOT (a <=> b AND x <=> y)").count() == 0


def test_views_equal_the_transforms_without_python(spark, profiles):
    messages = inbox(spark)
    views = register(spark, messages, profiles, None, EUROPEAN)
    assert views == ["inbox", "book", "signals", "risk", "decisions", "queue"]
    want = build_queue(messages, profiles, None, EUROPEAN)
    got = spark.table("queue")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = spark.sql("SELECT keyword_issue(text) FROM inbox")._jdf.queryExecution().executedPlan()
    assert "Python" not in plan.toString()
