"""Trained text classifier: one shared feature stage, one head per label."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import leaving_confirmed
from ..lexicon import DEFAULT, Lexicon
from ..operators.splits import message_stratum, stratified_split
from ..schemas import ISSUES, SIGNALS
from ..session import map_batches
from . import softmax as sm
from . import store
from .vocabulary import MAX_TOKENS, byte_tokens, lowered_bytes, token_counts, tokens

HEADS = {"issue_type": ISSUES, "churn_signal": SIGNALS}


def label_index(column: str, labels: list[str]) -> Column:
    """Position in the fixed label order; null for an unknown label."""
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(column))
    return F.when(position > 0, (position - 1).cast("int"))


def best_label(probabilities: Column, labels: list[str]) -> tuple[Column, Column]:
    """(label, confidence): first largest probability."""
    top = F.array_max(probabilities)
    at = F.array_position(probabilities, top).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in labels]), at), top


def train_test(messages: DataFrame, test_ratio: float = 0.2,
               validation_ratio: float = 0.15) -> DataFrame:
    """Adds ``part``: test (stratified), then validation out of the rest, else train."""
    first = stratified_split(messages, message_stratum(), "message_id", test_ratio, "_test")
    both = stratified_split(first, message_stratum(), "message_id", validation_ratio, "_val",
                            among=~F.col("_test"))
    return both.withColumn("part", F.when(F.col("_test"), "test").when(
        F.col("_val"), "validation").otherwise("train")).drop("_test", "_val")


def fold(key: str, folds: int) -> Column:
    """A fixed fold per key, from the head of its md5; the same on every run and in SQL."""
    head = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(folds)).cast("int")


def token_array(text: str = "text") -> Column:
    """The tokens of a text; a null text has none."""
    return F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_tokens")


@dataclass
class TextClassifier:
    """Fitted feature stage and heads; use as a ``classify`` stage of ``listen``."""

    features: PipelineModel
    heads: dict[str, PipelineModel]
    lexicon: Lexicon = DEFAULT
    name: str = "trained"

    def __call__(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in HEADS]
        low = F.lower("text")
        out = self.features.transform(df.select(*kept, token_array()))
        for head, labels in HEADS.items():
            out = self.heads[head].transform(out)
            label, confidence = best_label(vector_to_array(f"_prob_{head}"), labels)
            out = out.withColumns({head: label, f"_conf_{head}": confidence})
        return out.select(
            *kept, leaving_confirmed(low, self.lexicon).alias("leaving_confirmed"), "issue_type",
            F.col("_conf_issue_type").alias("issue_confidence"), "churn_signal",
            F.col("_conf_churn_signal").alias("churn_signal_confidence"),
            F.lit(self.name).alias("classifier"))

    def save(self, path: str) -> None:
        """A new version below ``path``: feature stage and heads become current together."""
        def write(to: str) -> None:
            self.features.write().save(f"{to}/features")
            for head, model in self.heads.items():
                model.write().save(f"{to}/{head}")
        store.save(SparkSession.active(), path, write)


def load(path: str, lexicon: Lexicon = DEFAULT,
         name: str = "trained") -> TextClassifier | None:
    """The current saved classifier, or None where none was saved."""
    return store.load(SparkSession.active(), path, lambda at: TextClassifier(
        PipelineModel.load(f"{at}/features"),
        {head: PipelineModel.load(f"{at}/{head}") for head in HEADS}, lexicon, name))


@dataclass(frozen=True)
class Rows:
    """The prepared rows with a known label of a head: all, or those outside a fold."""

    head: str
    moments: sm.Moments
    without: int = -1

    def count(self) -> int:
        return self.moments.rows


@dataclass
class Prepared:
    """The feature stage and the token counts, by fold, that fits read; ``ranked`` are the most
    frequent tokens, ties by descending token, and ``columns`` where the blocks count them."""

    features: PipelineModel
    ranked: list[str]
    columns: dict[str, int]
    blocks: sm.Blocks
    folds: dict[tuple[int, int], sm.Moments]
    by_label: list[np.ndarray]

    def fold_rows(self, head: str, k: int) -> int:
        found = self.folds.get((list(HEADS).index(head), k))
        return found.rows if found else 0

    def of(self, head: str, without: int = -1) -> Rows:
        at = list(HEADS).index(head)
        first, *rest = [m for (h, k), m in self.folds.items() if h == at and k != without]
        return Rows(head, sum(rest, first), without)

    def release(self) -> None:
        self.blocks.rows.unpersist()


def _blocks(messages: DataFrame, columns: dict[str, int], inputs: int,
            where: Column) -> sm.Blocks:
    """The counts of some tokens in blocks of one fold, kept; labels are positions, -1 if
    unknown."""
    width, spark = len(columns), messages.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = {w.encode(): i for w, i in columns.items()}, sm.block_rows(width)
        held: dict[int, tuple[list, list, list]] = {}

        def block(fold: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([fold], pa.int32()),
                pa.array([sm.pack(*held.pop(fold))], pa.binary())], ["fold", "block"])

        for b in batches:
            labels = zip(*[b.column(i).to_pylist() for i in range(2, b.num_columns)])
            for lowered, fold, given in zip(b.column(0), b.column(1).to_pylist(), labels):
                found = Counter(byte_tokens(lowered.as_py() or b""))
                counts = {at[w]: n for w, n in found.items() if w in at}
                own = held.setdefault(fold, ([], [], []))
                for part, value in zip(own, (given, np.array(list(counts), np.int64),
                                             np.array(list(counts.values()), np.int64))):
                    part.append(value)
                if len(own[0]) == size:
                    yield block(fold)
        for fold in list(held):
            yield block(fold)

    labelled = messages.select(lowered_bytes(), where.alias("_fold"), *[
        F.coalesce(label_index(h, labels), F.lit(-1)).alias(f"_label_{h}")
        for h, labels in HEADS.items()])
    tasks = spark.sparkContext.defaultParallelism
    rows = map_batches(labelled, work, sm.BLOCKS).repartition(tasks).persist()
    return sm.Blocks(rows, width, inputs, tasks)


def prepare(messages: DataFrame, vocabulary: int = MAX_TOKENS, folds: int = 3,
            key: str = "message_id") -> Prepared:
    """Counts the tokens once, for any number of fits on the same messages; a row without a key is
    in fold 0.

    Of equally frequent tokens at the end of the vocabulary the first in descending order are
    taken; texts of one partition leave the choice to ``CountVectorizer``, which is settled there
    (over several partitions it varies from run to run).
    """
    where = F.coalesce(fold(key, folds), F.lit(0)) if key in messages.columns else F.lit(0)
    top = token_counts(messages).orderBy(F.col("n").desc(), F.col("token").desc()).limit(
        vocabulary + 1).collect()
    if not top:
        raise ValueError("no tokens to count")
    ranked, texts = [r["token"] for r in top[:vocabulary]], messages.select(token_array())
    tied = len(top) > vocabulary and top[-1]["n"] == top[-2]["n"]
    if tied and texts.rdd.getNumPartitions() == 1:
        chosen = CountVectorizer(inputCol="_tokens", outputCol="_counts",
                                 vocabSize=vocabulary).fit(texts)
    else:
        chosen = CountVectorizerModel.from_vocabulary(
            ranked, inputCol="_tokens", outputCol="_counts")
    own = chosen.vocabulary
    columns = {w: i for i, w in enumerate(dict.fromkeys([*own, *ranked]))}
    blocks = _blocks(messages, columns, len(own), where)
    found, by_label = sm.moments(blocks, [len(labels) for labels in HEADS.values()], folds)
    return Prepared(PipelineModel([chosen]), ranked, columns, blocks, found, by_label)


@dataclass
class Head:
    """A regression still to be fitted."""

    name: str
    reg: float
    max_iter: int

    def fit(self, rows: Rows) -> sm.Fit:
        """Begins the fit; ``softmax.solve`` takes any number of them to their ends."""
        return sm.Fit(list(HEADS).index(self.name), rows.without, self.reg, self.max_iter,
                      rows.moments)


def _head(h: str, reg: float, max_iter: int) -> Head:
    return Head(h, reg, max_iter)


def _model(h: str, fitted: sm.Fit, spark: SparkSession) -> PipelineModel:
    return PipelineModel([fitted.model(
        spark, f"LogisticRegression_{uuid.uuid4().hex[:12]}", featuresCol="_counts",
        labelCol=f"_label_{h}", probabilityCol=f"_prob_{h}", rawPredictionCol=f"_raw_{h}",
        predictionCol=f"_pred_{h}")])


def fit(messages: DataFrame, lexicon: Lexicon = DEFAULT, vocabulary: int = MAX_TOKENS,
        reg: float | dict[str, float] = 0.01, max_iter: int = 60,
        name: str = "trained", prepared: Prepared | None = None) -> TextClassifier:
    """Fit both heads on labelled messages; ``reg`` may differ by head.

    The sparse token counts, not the texts, are what the iterations read; with ``prepared`` (of the
    same messages) they are not counted again.
    """
    regs = reg if isinstance(reg, dict) else {h: reg for h in HEADS}
    own = prepared or prepare(messages, vocabulary)
    fits = {h: _head(h, regs[h], max_iter).fit(own.of(h)) for h in HEADS}
    sm.solve(own.blocks, list(fits.values()))
    if prepared is None:
        own.release()
    heads = {h: _model(h, fitted, messages.sparkSession) for h, fitted in fits.items()}
    return TextClassifier(own.features, heads, lexicon, name)


def tune(messages: DataFrame, regs: tuple[float, ...] = (0.001, 0.01, 0.1), folds: int = 3,
         key: str = "message_id", vocabulary: int = MAX_TOKENS, max_iter: int = 60,
         prepared: Prepared | None = None) -> dict[str, dict[float, float]]:
    """Mean accuracy over fixed folds by head and regularisation, by cross-validation.

    Only the fits that are judged are made, side by side, and all read the counts that are kept
    once.
    """
    own = prepared or prepare(messages, vocabulary, folds, key)
    for h in HEADS:
        for k in range(folds):
            if not own.fold_rows(h, k):
                raise ValueError(f"fold {k} of {h} is empty")
    cases = [(h, reg, k) for h in HEADS for reg in regs for k in range(folds)]
    fits = [_head(h, reg, max_iter).fit(own.of(h, without=k)) for h, reg, k in cases]
    sm.solve(own.blocks, fits)
    found = {(h, reg, k): n / own.fold_rows(h, k)
             for (h, reg, k), n in zip(cases, sm.hits(own.blocks, fits))}
    if prepared is None:
        own.release()
    return {h: {reg: sum(found[h, reg, k] for k in range(folds)) / folds for reg in regs}
            for h in HEADS}


def best_regs(tuned: dict[str, dict[float, float]]) -> dict[str, float]:
    """Per head the value with the best mean accuracy; of equal ones the strongest."""
    return {h: max(scores, key=lambda r: (scores[r], r)) for h, scores in tuned.items()}


def choose(preferred: str, finetuned=None, trained=None):
    """The classifier to serve: the preferred one if present, else trained, else None (keywords)."""
    if preferred == "finetuned" and finetuned is not None:
        return finetuned
    return trained
