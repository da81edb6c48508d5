import dataclasses
import math
import os
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidekeep.learning import churn_model as cm
from tidekeep.learning import newton as nw
from tidekeep.learning import store
from tidekeep.learning import text_model as tm
from tidekeep.learning import vocabulary as voc
from tidekeep.operators.assess import assess, score_book
from tidekeep.operators.listen import listen
from tidekeep.operators.metrics import roc_auc
from tidekeep.plans.catalog import Tables
from tidekeep.sources import versions
from tidekeep.schemas import ISSUES, PROFILE, SIGNALS


@pytest.fixture(scope="module")
def book(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        gone = rng.random() < 0.3
        rows.append((f"C{i}", "MENA", rng.randrange(4, 180),
                     rng.choice(["Mass", "Premium", "Private"]), rng.randrange(1, 7),
                     rng.uniform(1e3, 1e5), rng.uniform(-0.6, -0.1) if gone
                     else rng.uniform(-0.2, 0.25), rng.random() < (0.4 if gone else 0.9),
                     rng.randrange(12), rng.random() < (0.7 if gone else 0.15),
                     rng.randrange(6), rng.uniform(-0.8, 0.4), rng.randrange(1000, 90000), gone))
    return spark.createDataFrame(rows, PROFILE)


@pytest.fixture(scope="module")
def model(book):
    return cm.fit_logistic(book)


def test_logistic_model(spark, book, model):
    scored = score_book(book, cm.scorer(model))
    assert scored.columns[:len(book.columns)] == book.columns
    assert dict(scored.dtypes)["salary_credit_active"] == "boolean"
    auc = roc_auc(scored.withColumn("y", F.col("churned").cast("int")), "y",
                  "behaviour_risk").first().auc
    assert auc > 0.95
    rows = cm.coefficients(model, spark).collect()
    weights = {r.feature: r.coefficient for r in rows}
    assert weights["balance_trend_3m"] < 0 and weights["intl_transfer_spike"] > 0
    assert [r.coefficient for r in rows] == sorted(r.coefficient for r in rows)
    assert len(weights) == 13 and "segment_Private" in weights


def test_newton_fit_is_the_minimum(spark, book, model):
    fit = nw.fit(book)
    gradients = {r.feature: r.gradient for r in nw.optimality(fit, book).collect()}
    assert len(gradients) == 14 and max(map(abs, gradients.values())) < 1e-12
    # The library's optimiser stops near the same minimum, on sample deviations.
    scale = math.sqrt(299 / 300)
    weights = dict(zip(fit.features, fit.weights))
    for r in cm.coefficients(model, spark).collect():
        own = weights[r.feature] * (1 if r.feature.startswith("segment") else 1 / scale)
        assert abs(own - r.coefficient) < 0.02 * max(1, abs(own))
    moved = dataclasses.replace(fit, weights=[w + 0.01 for w in fit.weights])
    assert max(abs(r.gradient) for r in nw.optimality(moved, book).collect()) > 1e-5


def test_newton_fit_edge_cases(spark, book):
    fit = nw.fit(book)
    gaps = book.withColumn("tenure_months", F.when(F.col("customer_id") != "C7",
                                                   F.col("tenure_months")))
    assert nw.fit(gaps).rows == 299
    still = nw.fit(book.withColumn("products_held", F.lit(3)))
    assert still.weights[nw.FEATURES.index("products_held")] == 0.0
    # Perfectly separated: only the penalty holds the weights.
    apart = book.withColumn("balance_trend_3m", F.when(F.col("churned"), -1.0).otherwise(1.0))
    sure = nw.fit(apart)
    assert sure.steps < nw.MAX_STEPS
    assert max(abs(r.gradient) for r in nw.optimality(sure, apart).collect()) < 1e-12
    for bad in (book.filter("churned"), book.filter("1 = 0")):
        with pytest.raises(ValueError):
            nw.fit(bad)
    new = fit(book.limit(1).withColumn("segment", F.lit(None).cast("string"))).first()
    assert 0 < new.behaviour < 1


def test_held_out_customers_are_not_fitted(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the data folder")
    tables = Tables(spark, folder)
    total, held = tables.profile.count(), tables.held_out.count()
    assert tables.churn_fit.rows == total - held and held == math.ceil(total * 0.25)


def test_unknown_segment_is_all_zero(spark, book):
    fit = Pipeline(stages=cm.feature_stages()).fit(cm.labelled_features(book))
    new = cm.labelled_features(book.limit(1).withColumn("segment", F.lit("Platinum")))
    assert fit.transform(new).select(vector_to_array("_onehot")).first()[0] == [0.0, 0.0, 0.0]


def test_save_load_and_fallback(spark, book, model, tmp_path):
    path = str(tmp_path / "model")
    assert cm.load_or_none(spark, path) is None
    cm.save(model, path)
    again = cm.load_or_none(spark, path)
    pick = book.limit(5)
    a = [r.behaviour for r in cm.scorer(model)(pick).collect()]
    assert a == [r.behaviour for r in cm.scorer(again)(pick).collect()]


def test_versions_switch_last(spark, tmp_path):
    root = str(tmp_path / "store")

    def write(text):
        return lambda to: spark.createDataFrame([(text,)], "value string").write.text(to)

    def read(at):
        return spark.read.text(at).first()["value"]

    def fail(to):
        write("half")(to)
        raise OSError("lost")

    assert store.load(spark, root, read) is None
    store.save(spark, root, write("one"))
    with pytest.raises(OSError):
        store.save(spark, root, fail)
    assert store.load(spark, root, read) == "one"
    first = versions.current(spark, root)["version"]
    store.save(spark, root, write("two"))
    assert store.load(spark, root, read) == "two" and (tmp_path / "store" / first).is_dir()
    store.save(spark, root, write("three"))
    assert store.load(spark, root, read) == "three" and not (tmp_path / "store" / first).exists()


def test_newton_fit_saves_and_loads(spark, book, tmp_path):
    path = str(tmp_path / "fit")
    assert nw.LogisticFit.load(spark, path) is None
    fit = nw.fit(book)
    fit.save(spark, path)
    assert nw.LogisticFit.load(spark, path) == fit


def test_boosted_trees(spark, book):
    scored = cm.scorer(cm.fit_trees(book, trees=5))(book)
    auc = roc_auc(scored.withColumn("y", F.col("churned").cast("int")), "y", "behaviour").first()
    assert auc.auc > 0.9


def test_standardised(spark, book):
    row = cm.standardised(book).agg(F.avg("tenure_months").alias("m"),
                                    F.stddev_pop("tenure_months").alias("s")).first()
    assert math.isclose(row.m, 0, abs_tol=1e-9) and math.isclose(row.s, 1, abs_tol=1e-9)


def test_vocabulary_order_and_ids(spark):
    df = spark.createDataFrame([("B b, a! A c'd",), ("b z " + "q " * 40,)],
                               "text string").coalesce(1)
    vocabulary = voc.vocabulary_list(voc.fit_vocabulary(df))
    assert vocabulary == ["q", "b", "a", "z", "cd"]  # by count, ties in descending order
    ids = [r.token_ids for r in voc.vectorise(df, vocabulary[:3]).collect()]
    assert ids[0] == [3, 3, 4, 4, 1] + [0] * 27 and ids[1][:3] == [3, 1, 2] and len(ids[1]) == 32
    assert len(voc.vocabulary_list(voc.fit_vocabulary(df, max_tokens=4), 4)) == 2


def test_text_classifier(spark, book, model, tmp_path):
    words = {i: f"topic{n}" for n, i in enumerate(ISSUES)}
    tones = {"High": "goodbye", "Medium": "hmm", "Low": "thanks"}
    rows = [(f"m{i}{s}{k}", "C1", f"{words[i]} {tones[s]} {k}", i, s)
            for i in ISSUES for s in SIGNALS for k in range(4)]
    messages = spark.createDataFrame(rows, "message_id string, customer_id string, text string,"
                                           " issue_type string, churn_signal string")
    classifier = tm.fit(messages, max_iter=30)
    out = listen(messages.drop("issue_type", "churn_signal"), classify=classifier)
    joined = out.join(messages.select("message_id", F.col("issue_type").alias("i"),
                                      F.col("churn_signal").alias("s")), "message_id")
    assert joined.filter("i = issue_type and s = churn_signal").count() == len(rows)
    assert joined.select("classifier").distinct().collect()[0][0] == "trained"
    assert assess(out, book, cm.scorer(model)).count() == len(rows)
    classifier.save(str(tmp_path / "text"))
    again = tm.load(str(tmp_path / "text"))
    assert again(messages).select("issue_type").count() == len(rows)
    assert tm.choose("finetuned", None, classifier) is classifier
    assert tm.choose("finetuned", again, classifier) is again
    assert tm.choose("trained", again, None) is None


def test_best_label_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "p array<double>")
    label, conf = tm.best_label(F.col("p"), ["a", "b", "c"])
    assert {tuple(r) for r in df.select(label, conf).collect()} == {("a", 0.4), ("c", 0.7)}
