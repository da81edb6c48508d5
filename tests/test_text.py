import pytest
from conftest import by
from pyspark.sql import functions as F

from tidekeep.functions import text as tx
from tidekeep.lexicon import DEFAULT, EUROPEAN
from tidekeep.operators import listen as ls

WORD = "zz"  # in no list


def frame(spark, texts):
    return spark.createDataFrame([(f"m{i}", "A", t) for i, t in enumerate(texts)],
                                 "message_id string, customer_id string, text string")


@pytest.mark.parametrize("text, language, confidence", [
    ("", "en", 0.5),
    ("12345 678", "en", 0.5),
    ("hello مرحبا", "ar", 0.99),
    (" ".join(["hai"] + [WORD] * 8), "en", 0.9),        # 1 in 9 is below the floor
    (" ".join(["hai"] + [WORD] * 7), "hi", 0.725),      # 1 in 8 is above
    (" ".join(["ang"] + [WORD] * 7), "tl", 0.725),
    ("hai ang zz zz", "hi", 0.85),                      # equal shares: the first list wins
    ("hai ang ng zz", "tl", 1.1),                       # capped below
    ("hai hai hai", "hi", 1.6),
    ("HAI Zz zz zz", "hi", 0.85),
    ("what is the opening time", "en", 0.9),
])
def test_language(spark, text, language, confidence):
    row = ls.with_detected_language(frame(spark, [text])).first()
    assert row.language == language
    assert row.language_confidence == pytest.approx(min(confidence, 0.99))


def test_exact_floor_is_not_enough(spark):
    text = " ".join(["hai"] * 3 + [WORD] * 22)  # 3/25 = 0.12
    assert ls.with_detected_language(frame(spark, [text])).first().language == "en"


def test_more_languages_by_configuration(spark):
    row = ls.with_detected_language(frame(spark, ["der die das xx"]), EUROPEAN).first()
    assert row.language == "de"


def test_words_split_at_other_letters(spark):
    df = spark.createDataFrame([("don't stop über 3x",)], "t string")
    assert df.select(tx.words(F.lower("t")).alias("w")).first().w == [
        "don't", "stop", "ber", "x"]


def test_keyword_labels(spark):
    got = by(ls.with_keyword_labels(frame(spark, [
        "please CLOSE MY ACCOUNT and transfer the rest",   # first class in order wins
        "what happens now",                                # 'app' inside a word counts
        "Emirates flight",                                 # 'emi' too
        "I am leaving the UAE",
        "not sure about this card",
        "hello there",
        "إغلاق",
    ])), "message_id")
    assert [got[f"m{i}"].issue_type for i in range(7)] == [
        "Account_Closure", "App_Technical", "Loan_Mortgage", "General_Query", "Card_Services",
        "General_Query", "Account_Closure"]
    assert [got[f"m{i}"].churn_signal for i in range(6)] == [
        "Low", "Low", "Low", "High", "Medium", "Low"]
    assert got["m3"].leaving_confirmed and not got["m4"].leaving_confirmed
    assert (got["m0"].issue_confidence, got["m5"].issue_confidence) == (0.7, 0.4)
    assert (got["m3"].churn_signal_confidence, got["m5"].churn_signal_confidence) == (0.75, 0.6)


@pytest.mark.parametrize("text, amounts", [
    ("AED 1,250.50", [1250.5]), ("300 dirhams", [300.0]), ("aed ,", None), ("500", None),
    ("Dhs. 20 and dh30 and 20 AED", [20.0, 30.0, 20.0]), ("aed ,.5", [0.5]),
    ("AED ٣٠٠", [300.0]), ("pay 5 aed 7 now", [5.0]), ("no money", None),
    ("aed 12", [12.0]),
])
def test_amounts(spark, text, amounts):
    assert ls.with_entities(frame(spark, [text])).first().entities.amounts_aed == amounts


def test_entities(spark):
    e = ls.with_entities(frame(spark, [
        "next month I move from the UAE to India, tomorrow my salary account and otp"])).first()
    assert e.entities.dates == ["next month", "tomorrow"]
    assert e.entities.destinations == ["India", "UAE"]
    assert e.entities.products == ["OTP", "account", "salary account"]
    none = ls.with_entities(frame(spark, ["zz"])).first().entities
    assert none.dates is None and none.products is None and none.destinations is None


def test_reply_label(spark):
    df = spark.createDataFrame([("The label is MEDIUM or low",), ("no idea",), ("high",)],
                               "r string")
    out = [r[0] for r in df.select(tx.reply_label(F.col("r"), ["High", "Medium", "Low"])).collect()]
    assert out == ["Medium", "Low", "High"]


def test_inbox_cleaning_and_override(spark):
    raw = spark.createDataFrame(
        [(" ", None, " hi there ", "ar"), ("x", " ", "   ", None), ("y", "C1", "ok", "auto")],
        "message_id string, customer_id string, text string, lang_override string")
    rows = {r.message_id: r for r in ls.listen(ls.clean_inbox(raw)).collect()}
    assert set(rows) == {"LIVE", "y"}
    assert rows["LIVE"].customer_id == "UNKNOWN" and rows["LIVE"].text == "hi there"
    assert (rows["LIVE"].language, rows["LIVE"].language_confidence) == ("ar", 1.0)
    assert (rows["y"].language, rows["y"].language_confidence) == ("en", 0.9)
    assert rows["y"].classifier == "heuristic"


def test_signal_columns(spark):
    assert ls.listen(frame(spark, ["a"])).columns == ls.SIGNAL_COLUMNS
    assert DEFAULT.languages[0][0] == "hi"
