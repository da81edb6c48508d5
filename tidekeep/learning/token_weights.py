"""Two-head text classifiers as a table of token weights, scored by join, sum and softmax.

A linear text model is a weight per (head, token, class) and an intercept per class. Kept as a
table it can be read, joined and compared: ``from_heads`` takes the weights out of the fitted
logistic heads, ``from_counts`` computes those of a multinomial count model straight from the
labelled messages. The vocabulary has a fixed size, so the table has at most
``MAX_TOKENS`` x classes rows and goes to the scan of the texts; one row of sums per message is
exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import leaving_confirmed
from ..lexicon import DEFAULT, Lexicon
from ..session import written
from . import store
from .text_model import HEADS, Prepared, TextClassifier, best_label
from .vocabulary import MAX_TOKENS, fit_vocabulary, tokens

WEIGHTS = "head string, token string, label string, weight double"
CLASSES = [(head, label) for head, labels in HEADS.items() for label in labels]


def from_heads(model: TextClassifier, spark) -> DataFrame:
    """The weights of fitted logistic heads; a null token carries the intercept."""
    words = model.features.stages[0].vocabulary
    rows = []
    for head, labels in HEADS.items():
        fitted = model.heads[head].stages[-1]
        matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        for k, label in enumerate(labels[:len(matrix)]):
            rows.append((head, None, label, float(intercepts[k])))
            rows += [(head, words[j], label, float(matrix[k, j]))
                     for j in np.flatnonzero(matrix[k]).tolist()]
    return spark.createDataFrame(rows, WEIGHTS)


def from_counts(messages: DataFrame, max_tokens: int = MAX_TOKENS,
                prepared: Prepared | None = None) -> DataFrame:
    """Log odds of a multinomial count model: ln((n + 1) / (class tokens + vocabulary)) per token
    and class, ln((messages + 1) / (all + classes)) as intercepts. Labels outside the fixed list
    are left out; a class without messages keeps the smoothed odds. With ``prepared`` (of the same
    messages, over as many tokens or more) the texts are not read again."""
    spark = messages.sparkSession
    known = F.concat(*[F.array(*[F.struct(F.lit(h).alias("head"), F.lit(x).alias("label"))
                                 for x in labels]) for h, labels in HEADS.items()])
    if prepared is None:
        words, rows, counts = _counted(messages, max_tokens, known)
    else:
        words, rows, counts = _prepared_counts(spark, max_tokens, prepared)
    size = words.count()
    classes = spark.range(0, 1, 1, 1).select(F.explode(known).alias("class"))
    total = rows.groupBy("class.head").agg(F.sum("d").alias("all"))
    priors = classes.join(rows, "class", "left").withColumn("head", F.col("class.head")).join(
        total, "head").select(
        "head", F.lit(None).cast("string").alias("token"), F.col("class.label").alias("label"),
        F.log((F.coalesce("d", F.lit(0)) + 1) / (F.col("all") + _classes(F.col("head"))))
        .alias("weight"))
    sums = counts.groupBy("class").agg(F.sum("n").alias("of"))
    cells = words.select("token", F.explode(known).alias("class")).join(
        sums, "class", "left").join(counts, ["class", "token"], "left")
    odds = cells.select("class.head", "token", "class.label", F.log(
        (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("of", F.lit(0)) + size)).alias("weight"))
    return priors.unionByName(odds)


def _counted(messages: DataFrame, max_tokens: int,
             known: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(token), (class, messages) and (class, token, n) from the texts."""
    words = written(fit_vocabulary(messages, max_tokens=max_tokens).select("token"), "vocabulary")
    pairs = F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("label")) for h in HEADS])
    labelled = messages.select("text", F.explode(pairs).alias("class")).filter(
        F.array_contains(known, F.col("class")))
    rows = written(labelled.groupBy("class").agg(F.count("*").alias("d")), "class-rows")
    # Bounded: vocabulary x classes rows.
    counts = written(labelled.select("class", F.explode(tokens(F.col("text"))).alias("token")).join(
        F.broadcast(words), "token").groupBy("class", "token").agg(F.count("*").alias("n")),
        "class-tokens")
    return words, rows, counts


def _prepared_counts(spark, max_tokens: int,
                     prepared: Prepared) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``_counted`` from counts that were made once."""
    kept, rows, counts = prepared.ranked[:max_tokens - 2], [], []
    at = [prepared.columns[w] for w in kept]
    for (head, labels), table in zip(HEADS.items(), prepared.by_label):
        found = prepared.of(head).moments.per_label
        for k, label in enumerate(labels):
            if found[k]:
                rows.append(((head, label), int(found[k])))
            counts += [((head, label), kept[j], int(table[k, at[j]]))
                       for j in np.flatnonzero(table[k, at]).tolist()]
    key = "class struct<head: string, label: string>"
    return tuple(written(spark.createDataFrame(found, schema), purpose) for found, schema, purpose
                 in (([(w,) for w in kept], "token string", "vocabulary"),
                     (rows, f"{key}, d bigint", "class-rows"),
                     (counts, f"{key}, token string, n bigint", "class-tokens")))


def _classes(head: Column) -> Column:
    out = F.lit(0)
    for h, labels in HEADS.items():
        out = F.when(head == h, len(labels)).otherwise(out)
    return out


def scored(messages: DataFrame, weights: DataFrame, key: str = "message_id",
           text: str = "text") -> DataFrame:
    """(key, <head>, <head>_confidence ...): the class with the largest sum of weights and its
    softmax share, ties to the first label. ``key`` is unique. Tokens without a weight count
    nothing, so a text without known tokens gets the class of the largest intercept."""
    names = [f"w{k}" for k in range(len(CLASSES))]
    wide = weights.groupBy("token").agg(*[
        F.sum(F.when((F.col("head") == h) & (F.col("label") == label), F.col("weight"))).alias(n)
        for (h, label), n in zip(CLASSES, names)])
    table = written(wide, "token-weights")
    start = table.filter("token is null").select(F.struct(*names).alias("start")).scalar()
    # A token of a message goes through the join once, with its count.
    counted = messages.select(F.col(key), F.explode_outer(tokens(F.col(text))).alias("token"))
    sums = counted.join(F.broadcast(table.filter("token is not null")), "token", "left").groupBy(
        key).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    out = sums.withColumn("start", start)
    found = {}
    for head, labels in HEADS.items():
        own = [n for (h, _), n in zip(CLASSES, names) if h == head]
        logits = F.array(*[F.col(n) + F.coalesce(F.col(f"start.{n}"), F.lit(float("-inf")))
                           for n in own])
        shares = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
        total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
        label, top = best_label(logits, labels)
        found |= {head: label, f"{head}_confidence": 1.0 / total}
    return out.select(key, *[e.alias(n) for n, e in found.items()])


@dataclass
class WeightedClassifier:
    """A ``classify`` stage of ``listen`` over a weight table; message ids are unique."""

    weights: DataFrame
    lexicon: Lexicon = DEFAULT
    name: str = "weights"

    def save(self, path: str) -> None:
        """A new version of the weight table below ``path``."""
        store.save(self.weights.sparkSession, path, lambda to: self.weights.write.parquet(to))

    @classmethod
    def load(cls, spark, path: str, lexicon: Lexicon = DEFAULT,
             name: str = "weights") -> WeightedClassifier | None:
        """The current saved weights, or None where none were saved."""
        return store.load(spark, path, lambda at: cls(
            spark.read.schema(WEIGHTS).parquet(at), lexicon, name))

    def __call__(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in HEADS]
        labels = scored(df, self.weights)
        flagged = df.select(*kept, leaving_confirmed(F.lower("text"), self.lexicon)
                            .alias("leaving_confirmed"))
        return flagged.join(labels, "message_id").select(
            *kept, "leaving_confirmed", "issue_type",
            F.col("issue_type_confidence").alias("issue_confidence"), "churn_signal",
            F.col("churn_signal_confidence").alias("churn_signal_confidence"),
            F.lit(self.name).alias("classifier"))
