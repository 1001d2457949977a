"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of itself and of the lines before and after it; the field labels lines good or bad,
with weights for features and for transitions. It is fitted by maximum likelihood (L2) on labelled documents whose
lines all carry the document's label. A document's score is the mean of its lines' forward-backward
marginals of "good", weighted by line length. Only the text enters a score.

The fit uses at most `most_docs` labelled documents with `most_lines` lines in all, in the order of a hash
of doc_id; scoring covers every line of every document. Documents with a missing or contradictory label aren't learnt from;
without documents of both labels every score is the share of label 1 (0.5 without labels). A null text counts
as empty: one empty line. Texts and lines may be of any length. Repeated rows are scored each, alike; a null doc_id is not held out. A score that equals
the limit is good, so ties need no rule. Other columns, whatever their names, are kept by score() and keep_good() and ignored by predictions().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, tune

#: Character classes: upper case, other letters, digits, white space, bars, exclamation marks, other symbols, rest.
_UPPER, _LETTER, _DIGIT, _SPACE, _BAR, _BANG, _SYMBOL, _REST = range(8)
N_OWN = 10


def _char_classes() -> np.ndarray:
    out = np.full(0x10000, _LETTER, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isupper():
            out[i] = _UPPER
        elif c.isalpha():
            out[i] = _LETTER
        elif c.isdigit():
            out[i] = _DIGIT
        elif c.isspace():
            out[i] = _SPACE
        else:
            out[i] = _BAR if c == "|" else _BANG if c == "!" else _SYMBOL if c in "#$%&*<>=^~_{}[]\\@" else _REST
    return out


_CLASSES: list[np.ndarray] = []


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: own features, lengths; and the number of lines of each text."""
    if not _CLASSES:
        _CLASSES.append(_char_classes())
    n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    flat = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = int(n_lines.sum())
    line = np.cumsum(flat == 10) - (flat == 10)
    counts = np.bincount(line * 8 + _CLASSES[0][np.minimum(flat, 0xFFFF)], minlength=total * 8)[: total * 8].reshape(total, 8).astype(float)
    words = np.zeros((total, 3))
    for k, ln in enumerate(x for t in texts for x in t.split("\n")):
        w = ln.split()
        if w:
            words[k] = len(w), sum(map(eq, w, w[1:])), len(set(w))
    length = counts.sum(1) - 1  # without the newline
    n, letters = np.maximum(words[:, 0], 1), np.maximum(counts[:, _UPPER] + counts[:, _LETTER], 1)
    own = np.column_stack([
        counts[:, _UPPER] / letters,
        np.minimum(counts[:, _BANG] / n, 2),
        np.minimum(counts[:, _BAR] / n, 2),
        np.minimum(counts[:, _SYMBOL] / n, 3),
        counts[:, _DIGIT] / np.maximum(length, 1),
        words[:, 1] / n,
        words[:, 2] / n,
        np.log1p(words[:, 0]) / 5,
        np.minimum(letters / n, 30) / 10,
        np.minimum(counts[:, _REST] / n, 3),
    ])
    return own, length + 1, n_lines


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros beyond a text's ends), whether there are such, and 1."""
    ends = np.cumsum(n_lines)
    first = np.zeros(len(own), bool)
    last = np.zeros(len(own), bool)
    first[ends - n_lines], last[ends - 1] = True, True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last, np.ones(len(own))])


def marginals(emit: np.ndarray, n_lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line; expected transitions and log partition summed over texts.

    emit: a line's score for good (bad: 0); trans[a, b]: the score of b after a. All texts advance together, the longest first.
    """
    order = np.argsort(-n_lines, kind="stable")
    n, starts = n_lines[order], (np.cumsum(n_lines) - n_lines)[order]
    steps = int(n[0]) if len(n) else 0
    live = [int(np.searchsorted(-n, -t, side="left")) for t in range(steps + 1)]  # texts with more than t lines
    fwd = np.zeros((len(emit), 2))
    if steps:
        fwd[starts, 1] = emit[starts]
    for t in range(1, steps):
        at = starts[: live[t]] + t
        prev = fwd[at - 1]
        fwd[at, 0] = np.logaddexp(prev[:, 0] + trans[0, 0], prev[:, 1] + trans[1, 0])
        fwd[at, 1] = np.logaddexp(prev[:, 0] + trans[0, 1], prev[:, 1] + trans[1, 1]) + emit[at]
    bwd, pairs = np.zeros((len(emit), 2)), np.zeros((2, 2))
    ends = starts + n - 1
    z = np.logaddexp(fwd[ends, 0], fwd[ends, 1]) if steps else np.zeros(0)
    for t in range(steps - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        nxt = bwd[at + 1] + np.column_stack([np.zeros(len(at)), emit[at + 1]])
        for a in (0, 1):
            step = nxt + trans[a]
            bwd[at, a] = np.logaddexp(step[:, 0], step[:, 1])
            pairs[a] += np.exp(fwd[at, a, None] + step - z[: len(at), None]).sum(0)
    both = fwd + bwd
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs, z.sum()


class Field:
    """Weights of the field; constant: the score where nothing could be learnt."""

    def __init__(self, weights: np.ndarray | None, trans: np.ndarray | None, constant: float = 0.5) -> None:
        self.weights, self.trans, self.constant = weights, trans, constant
        self.slope, self.shift = 1.0, 0.0

    @classmethod
    def fit(cls, own: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> Field:
        """Adam on the mean negative log-likelihood per line; then a logistic curve from the logit of the weighted mean
        marginal to the documents' labels, so that a score reads as a probability."""
        if len(labels) == 0 or labels.min() == labels.max():
            return cls(None, None, float(labels.mean()) if len(labels) else 0.5)
        x = with_neighbours(own, n_lines)
        scale = np.maximum(x.std(0), 0.05)
        scale[-1] = 1
        x = x / scale
        y = np.repeat(labels, n_lines).astype(float)
        seen = np.zeros((2, 2))
        for v in (0, 1):
            seen[v, v] = (n_lines[labels == v] - 1).sum()
        theta = np.zeros(x.shape[1] + 4)
        m, v2 = np.zeros_like(theta), np.zeros_like(theta)
        for r in range(1, rounds + 1):
            w, trans = theta[:-4], theta[-4:].reshape(2, 2)
            p, pairs, _ = marginals(x @ w, n_lines, trans)
            g = np.concatenate([x.T @ (p - y), (pairs - seen).ravel()]) / len(x) + l2 * theta
            m, v2 = 0.9 * m + 0.1 * g, 0.99 * v2 + 0.01 * g * g
            theta = theta - 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v2 / (1 - 0.99**r)) + 1e-8)
        out = cls(theta[:-4] / scale, theta[-4:].reshape(2, 2))
        z, target = out._logits(own, n_lines, lengths), labels.astype(float)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps, damped
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([((p - target) * z).sum() + a - 1, (p - target).sum()]))
            a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
        out.slope, out.shift = (float(a), float(b)) if a > 0 else (1.0, 0.0)
        return out

    def _logits(self, own: np.ndarray, n_lines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logit of each text's mean marginal, weighted by line length."""
        p, _, _ = marginals(with_neighbours(own, n_lines) @ self.weights, n_lines, self.trans)
        starts = np.cumsum(n_lines) - n_lines
        mean = np.clip(np.add.reduceat(p * lengths, starts) / np.add.reduceat(lengths, starts), 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts or self.weights is None:
            return np.full(len(texts), self.constant)
        own, length, n_lines = line_features(texts)
        return 1 / (1 + np.exp(-(self.slope * self._logits(own, n_lines, length) + self.shift)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for evaluation: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most_docs: int = 3000, most_lines: int = 200_000) -> Field:
    """Fits on labelled documents that aren't held out; what reaches the driver is bounded by the two limits."""
    tune(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.where((F.col("quality") == F.col("most")) & ~held_out(F.col("doc_id")))
    ids = known.select(F.col("doc_id").alias("id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # most_docs rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            own, length, n = line_features([x or "" for x in batch.column(1).to_pylist()])
            own, ends = np.column_stack([own, length]), np.cumsum(n)
            small = [n_ <= most_lines for n_ in n]
            yield {"doc_id": batch.column(0), "quality": batch.column(2), "n": n, "own": [own[b - k : b].astype(np.float32).tobytes() if s else b"" for b, k, s in zip(ends, n, small, strict=True)]}

    types = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("n", pa.int64()), ("own", pa.binary())])
    found = arrow(chosen.select("doc_id", "text", F.col("quality").cast("int")), run, "doc_id long, quality int, n long, own binary", types)
    own, n_lines, y, lines = [], [], [], 0
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("own")).limit(most_docs).toLocalIterator():
        if lines + r.n > most_lines:
            continue
        lines += r.n
        own.append(np.frombuffer(r.own, np.float32).reshape(-1, N_OWN + 1))
        n_lines.append(r.n)
        y.append(r.quality)
    table = np.concatenate(own).astype(float) if own else np.zeros((0, N_OWN + 1))
    return Field.fit(table[:, :N_OWN], np.array(n_lines, np.int64), np.array(y, np.int64), table[:, N_OWN])


def score(docs: DataFrame, field: Field, name: str = "quality_score") -> DataFrame:
    """docs with a column of that name (replaced if there is one)."""
    tune(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = field.scores([x or "" for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least least, with the columns of docs."""
    name = f"_score_{uuid.uuid4().hex[:8]}"
    return score(docs, learn(docs, labels), name).where(F.col(name) >= least).drop(name)
