"""A sentence scorer that is trained here: multinomial logistic regression on hashed word n-grams, fitted by distributed gradient rounds.

Features are computed once and kept as a table. A round sends the weights out (a vector of fixed size), each task adds up the gradient of its sentences, and what the tasks have is summed by
feature in a shuffle, so the driver gets as many rows as there are features, however many sentences there are. Gradients are summed as integers (fixed point), so weights don't depend on
how sentences are dealt over tasks. The step is Nesterov's, of the size that the features' length allows. Training stops when macro-F1 on the validation part
hasn't grown for some rounds, and the weights of its best round are kept.

Sentences without words have no features: their scores are the class weights alone. A null text counts as empty. Rows without a label, or with one outside 0..classes - 1, take no part.
Equal scores: the lowest class wins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold import shared

WORD = re.compile(r"\w+")
#: Fixed point of a summed gradient, in bits.
POINT = 36


def hashed(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts: the different hashes of their words and pairs of neighbouring words, one text's after another's; and how many each text has."""
    flat, sizes = [], []
    for t in texts:
        w = WORD.findall((t or "").lower())
        own = {xxhash.xxh32_intdigest(x) % buckets for x in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))}
        flat += sorted(own)
        sizes.append(len(own))
    return np.array(flat, np.int64), np.array(sizes, np.int64)


def scores(weights: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of scores by class. weights: buckets + 1 rows, the last for all texts; a text's features count 1 / sqrt(their number)."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    own = np.stack([np.bincount(row, w[flat], len(sizes)) for w in weights[:-1].T], 1) if len(sizes) else np.zeros((0, weights.shape[1]))
    return own * scale[:, None] + weights[-1]


def probabilities(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True)) if len(s) else s
    return e / e.sum(1, keepdims=True) if len(s) else s


def macro_f1(cells: dict[tuple[int, int], int]) -> float:
    """Mean F1 over the classes that occur as label or prediction. cells: (label, predicted) -> n."""
    out = []
    for c in {x for k, n in cells.items() if n for x in k}:
        hit = cells.get((c, c), 0)
        out.append(2 * hit / (sum(n for (a, _), n in cells.items() if a == c) + sum(n for (_, b), n in cells.items() if b == c)))
    return sum(out) / len(out) if out else 0.0


@dataclass
class Scorer:
    """weights: buckets + 1 rows, a column for each class. history: macro-F1 on the validation part after each round."""

    weights: np.ndarray
    history: list[float] = field(default_factory=list)

    @property
    def buckets(self) -> int:
        return len(self.weights) - 1

    def model(self) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
        """For signals.scored(model=) and signals.model_label(): batches of texts to batches of labels."""
        weights, buckets = self.weights, self.buckets

        def labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(scores(weights, *hashed(texts.tolist(), buckets)).argmax(1).astype("int32"))

        return labels

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """feature, class, weight of all weights but zeros; the last feature stands for all texts and is there for every class."""
        rows = [(int(f), int(c), float(self.weights[f, c])) for f, c in zip(*np.nonzero(self.weights[:-1]), strict=True)]
        rows += [(self.buckets, c, float(w)) for c, w in enumerate(self.weights[-1])]
        return spark.createDataFrame(rows, "feature int, class int, weight double")

    @classmethod
    def from_frame(cls, rows: DataFrame) -> Scorer:
        got = rows.select("feature", "class", "weight").collect()  # at most buckets x classes
        weights = np.zeros((max(r.feature for r in got) + 1, max(r["class"] for r in got) + 1))
        for r in got:
            weights[r.feature, r["class"]] = r.weight
        return cls(weights)


def featurised(rows: DataFrame, buckets: int, classes: int) -> DataFrame:
    """rows: text, label, part. label, held (a validation row), idx (features) of rows of the parts train and validation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = hashed(batch.column(0).to_pylist(), buckets)
            idx = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), idx], names=["label", "held", "idx"])

    used = rows.where(F.col("part").isin("train", "validation") & F.col("label").between(0, classes - 1))
    return used.select("text", F.col("label").cast("int"), (F.col("part") == "validation").alias("held")).mapInArrow(run, "label int, held boolean, idx array<int>")


def _round(weights: np.ndarray, class_weight: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of what a task adds up: feature, class and the gradient of training rows in fixed point; or label, predicted and n of validation rows."""
    classes = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.shape, np.int64)
        cells = np.zeros((classes, classes), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            label, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            idx = batch.column(2)
            sizes = np.diff(idx.offsets.to_numpy())
            flat = idx.flatten().to_numpy()
            s = scores(weights, flat, sizes)
            np.add.at(cells, (label[held], s[held].argmax(1)), 1)
            g = probabilities(s)
            g[np.arange(len(label)), label] -= 1
            g *= np.where(held, 0, class_weight[label])[:, None]
            total[-1] += np.rint(g * 2.0**POINT).astype(np.int64).sum(0)
            scaled = np.rint(g / np.sqrt(np.maximum(sizes, 1))[:, None] * 2.0**POINT).astype(np.int64)
            np.add.at(total, flat, np.repeat(scaled, sizes, 0))
        some, c = np.nonzero(total)
        a, b = np.nonzero(cells)
        cols = [np.append(some, np.full(len(a), -1)), np.append(c, a * classes + b), np.append(total[some, c], cells[a, b])]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["feature", "cell", "value"])

    return run


def fit(rows: DataFrame, classes: int = 3, buckets: int = 1 << 15, rounds: int = 60, patience: int = 12, ridge: float = 1e-4, balanced: bool = True) -> Scorer:
    """rows: text, label (0..classes - 1), part (train, validation; others are left alone). balanced: every class has the same weight in all, whatever its size.
    Without training rows ValueError; without validation rows all rounds are run and the last weights kept."""
    table = shared.written(featurised(rows, buckets, classes), "scorer")
    sizes = {r.label: r.n for r in table.where("not held").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if not n:
        raise ValueError("no training rows")
    class_weight = np.array([n / (len(sizes) * sizes[c]) if balanced and sizes.get(c) else 1.0 for c in range(classes)])
    step = 1 / (1 + ridge)  # a text's features and the constant have length sqrt(2) at most, a softmax a curvature of 1/2, and class weights a mean of 1
    weights = ahead = np.zeros((buckets + 1, classes))
    best, history = weights, []
    for k in range(1, rounds + 1):
        got = table.mapInArrow(_round(ahead, class_weight), "feature int, cell int, value long").groupBy("feature", "cell").agg(F.sum("value").alias("value")).toPandas()
        gradient = np.zeros(weights.shape)
        own = got[got.feature >= 0]
        gradient[own.feature, own.cell] = own.value / 2.0**POINT / n
        cells = {divmod(int(c), classes): int(v) for c, v in got[got.feature < 0][["cell", "value"]].itertuples(index=False)}
        if cells:  # of the weights that this round began with
            history.append(macro_f1(cells))
            if history[-1] > max(history[:-1], default=-1.0):
                best = ahead
            if k - 1 - int(np.argmax(history)) >= patience:
                break
        after = ahead - step * (gradient + ridge * np.vstack([ahead[:-1], np.zeros((1, classes))]))
        ahead, weights = after + (k - 1) / (k + 2) * (after - weights), after
    return Scorer(best if history else weights, history)


def predicted(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """rows (text and others) with predicted."""
    from tonefold.operators.signals import model_label

    return rows.withColumn("predicted", model_label(scorer.model())(F.col("text")))
