"""Softmax fits side by side, against Spark's own fits one by one."""
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from tidekeep.functions.entities import BLANKS
from tidekeep.learning import softmax as sm
from tidekeep.learning import text_model as tm
from tidekeep.learning import token_weights as tw
from tidekeep.learning import vocabulary as voc
from tidekeep.schemas import ISSUES, SIGNALS

SCHEMA = "message_id string, text string, issue_type string, churn_signal string"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows = []
    for i in range(500):
        issue, signal = rng.choice(ISSUES[:4]), rng.choice(SIGNALS)
        words = rng.choices([f"{issue[:3]}{k}" for k in range(5)] + [signal] * 2
                            + [f"w{k}" for k in range(30)], k=rng.randrange(1, 25))
        rows.append((f"M{i}", " ".join(words) + " always", issue, signal))
    rows += [("E1", None, ISSUES[0], "Low"), ("E2", "", "no such label", "High"),
             (None, "w1 w1 w2", ISSUES[1], None), ("M1", "w3 " * 70_000, ISSUES[2], "Low")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def own(prepared, cases, max_iter=40):
    fits = [tm._head(h, reg, max_iter).fit(prepared.of(h, without=k)) for h, reg, k in cases]
    sm.solve(prepared.blocks, fits)
    return fits


def counted(df, prepared):
    return prepared.features.transform(df.select(tm.token_array(), *[
        tm.label_index(h, labels).cast("double").alias(f"_label_{h}")
        for h, labels in tm.HEADS.items()],
        F.coalesce(tm.fold("message_id", 3), F.lit(0)).alias("_fold")))


@pytest.mark.parametrize("direct", [64, 1])
def test_fits_are_those_of_spark(labelled, monkeypatch, direct):
    monkeypatch.setattr(sm, "DIRECT", direct)
    prepared = tm.prepare(labelled)
    cases = [("issue_type", 0.001, 1), ("churn_signal", 0.1, 0), ("issue_type", 0.01, -1),
             ("churn_signal", 0.0, 2), ("churn_signal", 0.001, 0)]
    table = counted(labelled, prepared).cache()
    for (h, reg, k), fitted in zip(cases, own(prepared, cases)):
        rows = table.filter(F.col(f"_label_{h}").isNotNull() & (F.col("_fold") != k))
        assert rows.count() == prepared.of(h, without=k).count()
        want = LogisticRegression(featuresCol="_counts", labelCol=f"_label_{h}", regParam=reg,
                                  family="multinomial", maxIter=40).fit(rows)
        close = dict(rtol=1e-5, atol=1e-6)
        assert np.allclose(want.coefficientMatrix.toArray(), fitted.weights, **close)
        assert np.allclose(want.interceptVector.toArray(), fitted.intercepts, **close)
    table.unpersist()
    prepared.release()


def test_a_pass_serves_all_fits(labelled, monkeypatch):
    prepared, passes, real = tm.prepare(labelled), [], sm.summed
    monkeypatch.setattr(sm, "summed", lambda *a: (passes.append(1), real(*a))[1])
    tm.tune(labelled, max_iter=6, prepared=prepared)
    assert len(passes) <= 20  # 18 fits of six steps, and one pass to judge them
    prepared.release()


def test_accuracies_and_labels_as_judged_by_spark(labelled):
    prepared = tm.prepare(labelled)
    tuned = tm.tune(labelled, regs=(0.01,), max_iter=8, prepared=prepared)
    table = counted(labelled, prepared).cache()
    for h in tm.HEADS:
        shares = []
        for k in range(3):
            rows = table.filter(F.col(f"_label_{h}").isNotNull())
            model = LogisticRegression(
                featuresCol="_counts", labelCol=f"_label_{h}", regParam=0.01, maxIter=8,
                family="multinomial").fit(rows.filter(F.col("_fold") != k))
            shares.append(model.transform(rows.filter(F.col("_fold") == k)).agg(F.avg(
                (F.col("prediction") == F.col(f"_label_{h}")).cast("double"))).first()[0])
        assert tuned[h][0.01] == pytest.approx(sum(shares) / 3, abs=1e-12)
    table.unpersist()
    prepared.release()


def test_one_label_only(spark):
    df = spark.createDataFrame([(f"M{i}", f"w{i % 4}", ISSUES[2], SIGNALS[i % 2])
                                for i in range(40)], SCHEMA)
    model = tm.fit(df, max_iter=5)
    assert {r.issue_type for r in model(df).collect()} == {ISSUES[2]}
    tuned = tm.tune(df, regs=(0.1,), max_iter=5)
    assert tuned["issue_type"] == {0.1: 1.0} and tuned["churn_signal"] == {0.1: 1.0}
    with pytest.raises(ValueError, match="no rows"):
        tm.fit(df.withColumn("issue_type", F.lit("unknown")))


@pytest.mark.parametrize("size", [2000, 9])
def test_count_model_from_the_same_counts(labelled, size):
    def table(weights):
        return {(r.head, r.token, r.label): round(r.weight, 12) for r in weights.collect()}
    prepared = tm.prepare(labelled)
    assert table(tw.from_counts(labelled, size, prepared)) == table(
        tw.from_counts(labelled, size))
    prepared.release()


def test_ties_at_the_end_of_the_vocabulary(spark):
    df = spark.createDataFrame([(f"M{i}", f"often a{i % 7} b{i} c{i}", ISSUES[i % 3],
                                 SIGNALS[i % 3]) for i in range(42)], SCHEMA).coalesce(1)
    stage = CountVectorizer(inputCol="_tokens", outputCol="_counts", vocabSize=20)
    want = stage.fit(df.select(tm.token_array())).vocabulary
    prepared = tm.prepare(df, vocabulary=20)
    assert prepared.features.stages[0].vocabulary == want
    assert set(prepared.ranked) - set(want) <= set(prepared.columns)
    assert prepared.ranked == voc.vocabulary_list(voc.fit_vocabulary(df, max_tokens=22), 22)
    fits = own(prepared, [("issue_type", 0.01, 0)])
    assert fits[0].weights.shape == (3, 20)
    assert tw.from_counts(df, 22, prepared).count() == tw.from_counts(df, 22).count()
    prepared.release()
    spread = tm.prepare(df.repartition(3), vocabulary=20)
    assert spread.features.stages[0].vocabulary == spread.ranked == prepared.ranked
    spread.release()


def test_nothing_to_count(spark):
    with pytest.raises(ValueError, match="no tokens"):
        tm.fit(spark.createDataFrame([("M1", " .! ", ISSUES[0], "Low")], SCHEMA))


def test_tokens_of_a_worker(spark):
    texts = [f"A{b}b,{b}{b}c'd" for b in BLANKS] + [
        None, "", " .!? ", "É é— x", "Straße\x85GROSS İx ΑΣ", "«¿qué?»　日本  z",
        "​together​", "a­b⁠c", "\U0001f600 \U0001f600 x-y_z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(voc.lowered_bytes(), tm.token_array()).collect():
        assert [t.decode() for t in voc.byte_tokens(bytes(r["_lowered"] or b""))] == r["_tokens"]


def test_token_counts_are_handed_on_in_parts(labelled, monkeypatch):
    want = {r.token: r.n for r in labelled.select(F.explode(tm.token_array()).alias("token"))
            .groupBy("token").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(voc, "HELD_TOKENS", 3)
    assert {r.token: r.n for r in voc.token_counts(labelled).collect()} == want
