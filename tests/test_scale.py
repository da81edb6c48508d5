"""Distributed operators against brute force on small, skewed data."""
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidekeep.operators import metrics as mt
from tidekeep.operators.key_filter import may_match
from tidekeep.operators.ranking import rank_rows, running_totals
from tidekeep.operators.skew import hot_keys, left_join
from tidekeep.operators.splits import stratified_split
from tidekeep.plans.queue import build_queue, queue_page


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    # one level (and one customer, one stratum) holds well over a third of all rows
    return [(f"k{i}", "hot" if i % 2 else f"c{rng.randrange(40)}",
             500 if i % 2 else rng.randrange(1001)) for i in range(4000)]


def test_global_rank(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, customer string, level int").repartition(7)
    got = {r.key: r.rank for r in rank_rows(df, -F.col("level"), "key").collect()}
    order = sorted(skewed, key=lambda r: (-r[2], md5(r[0]), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}


@pytest.mark.parametrize("places", [7, 27])
def test_key_filter_loses_no_match(spark, places):
    rows = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), "id").union(
        spark.sql("select cast(null as string), 1L"))
    keys = spark.range(0, 4000, 40).select(F.concat(F.lit("k"), F.col("id")).alias("key")).union(
        spark.sql("select cast(null as string)"))
    passed = may_match(rows, keys, "key", places)
    assert passed.columns == ["key", "id"]
    got = {r.id for r in passed.collect()}
    assert set(range(0, 4000, 40)) <= got
    assert len(got) <= (4000 if places == 7 else 110)
    assert may_match(rows, keys.filter("1 = 0"), "key", places).count() == 0


def test_page_agrees_with_rank(spark, skewed):
    df = spark.createDataFrame(skewed, "message_id string, customer string, level int").withColumn(
        "fused_risk", F.col("level") / 1000.0)
    page = [r.message_id for r in queue_page(df, 25).collect()]
    order = sorted(skewed, key=lambda r: (-r[2], md5(r[0]), r[0]))
    assert page == [r[0] for r in order[:25]]


def test_salted_join_equals_plain(spark, skewed):
    left = spark.createDataFrame(skewed + [("n", None, 1)],
                                 "key string, customer string, level int")
    right = spark.createDataFrame([("hot", 1), ("c1", 2), ("c2", 3)], "customer string, v int")
    assert [r.customer for r in hot_keys(left, "customer", 0.2).collect()] == ["hot"]
    plain = left_join(left, right, "customer", "key")
    salted = left_join(left, right, "customer", "key", hot_share=0.2, salts=8)
    cols = ["key", "customer", "level", "v"]
    assert sorted(map(str, plain.select(cols).collect())) == sorted(
        map(str, salted.select(cols).collect()))


def test_salted_queue_equals_plain(spark, profiles):
    texts = ["I am leaving the UAE", "the app crashed", "fee of AED 20", "hello"]
    rows = [(f"m{i}", "B" if i % 2 else f"c{i}" if i % 4 else "A", texts[i % 3], "en")
            for i in range(200)]
    df = spark.createDataFrame(rows, "message_id string, customer_id string, text string,"
                                     " language string")
    plain, salted = build_queue(df, profiles), build_queue(df, profiles, hot_share=0.3)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


@pytest.mark.parametrize("ratio", [0.2, 0.15, 0.25])
def test_split_is_exact(spark, skewed, ratio):
    df = spark.createDataFrame(skewed, "key string, stratum string, level int").repartition(5)
    got = {r.key for r in stratified_split(df, F.col("stratum"), "key", ratio).filter(
        "held_out").collect()}
    sizes = {}
    for _, stratum, _ in skewed:
        sizes[stratum] = sizes.get(stratum, 0) + 1
    take = math.ceil(len(skewed) * ratio)
    need = {st: n * take // len(skewed) for st, n in sizes.items()}
    rest = sorted(sizes, key=lambda st: (-(sizes[st] * take % len(skewed)), st))
    for st in rest[:take - sum(need.values())]:
        need[st] += 1
    want = set()
    for stratum in sizes:
        keys = sorted((r[0] for r in skewed if r[1] == stratum), key=lambda k: (md5(k), k))
        want |= set(keys[:need[stratum]])
    assert got == want and len(got) == take


def test_tiny_strata_may_stay_out(spark):
    df = spark.createDataFrame([("a", "big")] + [(f"b{i}", "huge") for i in range(99)],
                               "key string, stratum string")
    split = stratified_split(df, F.col("stratum"), "key", 0.2)
    assert split.filter("held_out is null").count() == 0
    assert split.filter("held_out").count() == 20


def test_running_totals(spark):
    rng = random.Random(1)
    values = sorted({rng.random() ** 6 for _ in range(3000)})  # crowded near zero
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "x double, n int")
    got = {r.x: r.n_before for r in running_totals(df, "x", ["n"], cells=16).collect()}
    total, want = 0, {}
    for i, v in enumerate(values):
        want[v] = total
        total += i % 3
    assert got == want


def test_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame([(int(a), s) for a, s in rows], "y int, s double")
    pos = [s for a, s in rows if a]
    neg = [s for a, s in rows if not a]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert mt.roc_auc(df, "y", "s").first().auc == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, s double")
    assert mt.roc_auc(df, "y", "s").first().auc is None


def test_class_report_and_confusion(spark):
    rows = [("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] * 1 + [("b", "a")] * 1
    df = spark.createDataFrame(rows, "t string, p string")
    got = {r.label: r for r in mt.class_report(df, "t", "p", ["a", "b", "c"]).collect()}
    assert got["a"].precision == pytest.approx(6 / 7) and got["a"].recall == pytest.approx(6 / 8)
    assert (got["c"].precision, got["c"].recall, got["c"].f1, got["c"].support) == (0, 0, 0, 0)
    assert got["accuracy"].f1 == pytest.approx(0.7) and got["accuracy"].support == 10
    assert got["weighted avg"].recall == pytest.approx(0.7)
    assert got["macro avg"].recall == pytest.approx((0.75 + 0.5 + 0) / 3)
    cells = {(r.actual, r.predicted): r.n for r in mt.confusion(df, "t", "p", ["a", "b", "c"])
             .collect()}
    assert len(cells) == 9 and cells[("a", "b")] == 2 and cells[("c", "a")] == 0


def test_accuracy_overall_and_per_language(spark):
    df = spark.createDataFrame([("m", "en", 1, 1), ("m", "en", 1, 0), ("m", "ar", 1, 1)],
                               "model string, language string, t int, p int")
    got = {r.language: (r.n, r.acc) for r in mt.accuracy(
        df, ["model"], {"acc": F.col("t") == F.col("p")}).collect()}
    assert got == {"(all)": (3, pytest.approx(2 / 3)), "en": (2, 0.5), "ar": (1, 1.0)}
