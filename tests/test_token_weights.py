"""Text classifiers as weight tables, against plain Python and against the fitted heads."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidekeep.learning import text_model as tm
from tidekeep.learning import token_weights as tw
from tidekeep.schemas import ISSUES, SIGNALS

WORDS = {"Card_Services": "card shop block", "Fees_Charges": "fee charge bill",
         "App_Technical": "app otp crash"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        issue = rng.choice(list(WORDS))
        words = rng.choices(WORDS[issue].split() + ["the", "my", "now"], k=rng.randrange(1, 9))
        signal = "High" if "now" in words else rng.choice(SIGNALS)
        rows.append((f"M{i}", " ".join(words), issue, signal))
    rows += [("E1", "", "Card_Services", "Low"), ("E2", None, "Fees_Charges", "Low"),
             ("E3", "never,seen! Zebra", "no such label", None), ("E4", "CARD  card", None, "Low")]
    return rows, spark.createDataFrame(
        rows, "message_id string, text string, issue_type string, churn_signal string")


def toks(text):
    return [w for w in ((text or "").lower().translate({ord(c): None for c in ",!"})).split()]


def brute(rows, size):
    counts = Counter(w for _, t, _, _ in rows for w in toks(t))
    words = {w for w, _ in sorted(counts.items(), key=lambda x: (x[1], x[0]), reverse=True)[:size]}
    heads = {"issue_type": (2, ISSUES), "churn_signal": (3, SIGNALS)}
    weights = {}
    for head, (at, labels) in heads.items():
        known = [r for r in rows if r[at] in labels]
        for label in labels:
            own = [r for r in known if r[at] == label]
            cell = Counter(w for r in own for w in toks(r[1]) if w in words)
            weights[head, label] = (math.log((len(own) + 1) / (len(known) + len(labels))), {
                w: math.log((cell[w] + 1) / (sum(cell.values()) + len(words))) for w in words})
    out = {}
    for key, text, _, _ in rows:
        for head, (_, labels) in heads.items():
            z = [weights[head, x][0] + sum(weights[head, x][1].get(w, 0.0) for w in toks(text))
                 for x in labels]
            top = max(z)
            out[key, head] = labels[z.index(top)], 1 / sum(math.exp(v - top) for v in z)
    return out


@pytest.mark.parametrize("size", [2000, 7])
def test_count_model(labelled, size):
    rows, df = labelled
    weights = tw.from_counts(df, max_tokens=size)
    got = {(r.message_id, h): (r[h], r[f"{h}_confidence"])
           for r in tw.scored(df, weights).collect() for h in tm.HEADS}
    want = brute(rows, size - 2)
    assert set(got) == set(want)
    for key, (label, share) in want.items():
        assert got[key][0] == label and got[key][1] == pytest.approx(share, abs=1e-12)


def test_heads_as_a_table_agree_with_the_model(spark, labelled):
    _, df = labelled
    model = tm.fit(df, max_iter=30)
    own = {r.message_id: r for r in model(df.select("message_id", "text")).collect()}
    for r in tw.scored(df, tw.from_heads(model, spark)).collect():
        o = own[r.message_id]
        assert (r.issue_type, r.churn_signal) == (o.issue_type, o.churn_signal)
        assert r.issue_type_confidence == pytest.approx(o.issue_confidence, abs=1e-9)
        assert r.churn_signal_confidence == pytest.approx(o.churn_signal_confidence, abs=1e-9)


def test_classify_stage(labelled):
    _, df = labelled
    stage = tw.WeightedClassifier(tw.from_counts(df))
    out = stage(df.withColumn("extra", F.lit(1)))
    assert out.columns == ["message_id", "text", "extra", "leaving_confirmed", "issue_type",
                           "issue_confidence", "churn_signal", "churn_signal_confidence",
                           "classifier"]
    assert out.count() == df.count() and stage(df.filter("1 = 0")).count() == 0


def test_tuning_over_fixed_folds(labelled):
    _, df = labelled
    folds = {r.message_id: r.f for r in df.select("message_id", tm.fold("message_id", 3)
                                                  .alias("f")).collect()}
    assert set(folds.values()) == {0, 1, 2}
    tuned = tm.tune(df, regs=(0.001, 5.0), max_iter=15)
    assert tuned["issue_type"][0.001] > tuned["issue_type"][5.0]
    assert tm.best_regs(tuned)["issue_type"] == 0.001
    assert tm.best_regs({"x": {0.1: 0.5, 1.0: 0.5}}) == {"x": 1.0}


def test_tuning_makes_only_the_judged_fits(labelled, monkeypatch):
    _, df = labelled
    sizes, real = [], tm._head

    def counted_fits(h, reg, max_iter):
        head = real(h, reg, max_iter)
        fit = head.fit
        head.fit = lambda rows: (sizes.append((h, rows.count())), fit(rows))[1]
        return head

    monkeypatch.setattr(tm, "_head", counted_fits)
    prepared = tm.prepare(df)
    assert set(tm.tune(df, max_iter=5, prepared=prepared)) == set(tm.HEADS)
    for h in tm.HEADS:
        own = [n for head, n in sizes if head == h]
        assert len(own) == 9 and sum(own) == 3 * 2 * prepared.of(h).count()
    fitted = tm.fit(df, max_iter=5, prepared=prepared)
    assert fitted.features is prepared.features
    prepared.release()


def test_tuning_needs_rows_in_every_fold(labelled):
    _, df = labelled
    with pytest.raises(ValueError, match="fold"):
        tm.tune(df.filter("message_id = 'M1'"))
