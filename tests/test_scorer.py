"""The trained sentence scorer against a plain fit, and what it makes of awkward texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonefold.operators import scorer as M
from tonefold.operators import signals as S
from tonefold.operators import stats as St

GOOD, BAD, PLAIN = (["record growth", "strong demand", "margins improved"], ["heavy loss", "weak demand", "margins declined"], ["the meeting begins", "we have offices", "thank you all"])


def sentences(n=240, seed=2):
    rnd = random.Random(seed)
    filler = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        label = rnd.choice([0, 1, 2, 2])
        w = rnd.choices(filler, k=rnd.randint(2, 9))
        w.insert(rnd.randrange(len(w)), rnd.choice((GOOD, BAD, PLAIN)[label]))
        out.append((" ".join(w) + rnd.choice([".", "!", ""]), label, rnd.choice(["train", "train", "train", "validation", "test"])))
    out += [(None, 2, "train"), ("", 0, "validation"), ("...", 1, "test"), ("no label", None, "train"), ("other label", 7, "train"), ("of no part", 1, None), out[0], out[0], ("long " * 20_000, 2, "train")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, label int, part string, idx int, held string")


def plain_fit(rows, classes, buckets, rounds, ridge):
    """Nesterov's rounds over a dense matrix; macro-F1 of the weights that each round begins with."""
    used = [(t, y, p) for t, y, p in rows if p in ("train", "validation") and y is not None and 0 <= y < classes]
    x = np.zeros((len(used), buckets + 1))
    for i, (t, _, _) in enumerate(used):
        w = M.WORD.findall((t or "").lower())
        own = {M.xxhash.xxh32_intdigest(g) % buckets for g in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]}
        x[i, list(own)] = 1 / max(len(own), 1) ** 0.5
        x[i, buckets] = 1
    y, held = np.array([r[1] for r in used]), np.array([r[2] == "validation" for r in used])
    n, sizes = (~held).sum(), np.bincount(y[~held], minlength=classes)
    cw = n / ((sizes > 0).sum() * np.maximum(sizes, 1))
    w = ahead = np.zeros((buckets + 1, classes))
    history, every = [], []
    for k in range(1, rounds + 1):
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pred = z[held].argmax(1)
        f1 = [2 * ((pred == c) & (y[held] == c)).sum() / ((pred == c).sum() + (y[held] == c).sum()) for c in range(classes) if c in pred or c in y[held]]
        history.append(sum(f1) / len(f1))
        every.append(ahead)
        g = ((p - np.eye(classes)[y]) * np.where(held, 0, cw[y])[:, None])
        decay = ridge * ahead
        decay[-1] = 0
        after = ahead - (x.T @ g / n + decay) / (1 + ridge)
        ahead, w = after + (k - 1) / (k + 2) * (after - w), after
    return history, every


def test_rounds_are_those_of_a_plain_fit(spark):
    rows = sentences()
    history, every = plain_fit(rows, 3, 512, 25, 1e-4)
    got = [M.fit(frame(spark, rows).repartition(k), buckets=512, rounds=25, patience=99) for k in (1, 5)]
    assert (got[0].weights == got[1].weights).all()  # however rows are dealt out
    assert np.allclose(got[0].history, history, atol=0.02)  # scores that tie in floats may differ in their last bit
    assert np.allclose(got[0].weights, every[int(np.argmax(got[0].history))], atol=1e-7)


def test_learns_and_stops(spark):
    rows = sentences(400, 5)
    found = M.fit(frame(spark, rows), buckets=4096, rounds=60, patience=5)
    assert len(found.history) < 60  # stopped
    test = St.macro_f1(M.predicted(frame(spark, rows).where("part = 'test' and label < 3"), found)).first()
    assert test.macro_f1 > 0.9
    again = M.Scorer.from_frame(found.to_frame(spark))
    assert (again.weights == found.weights).all()
    plain = M.scores(found.weights, *M.hashed([r[0] for r in rows], 4096)).argmax(1).tolist()
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, text string")
    assert [r.predicted for r in M.predicted(df, found).orderBy("i").collect()] == plain


def test_is_a_model_of_signals(spark):
    rows = sentences(300, 7)
    found = M.fit(frame(spark, rows), buckets=4096, rounds=20)
    sents = spark.createDataFrame([("A", "20240101", "ceo", "remarks", "record growth and w1", 4), ("A", "20240101", "ceo", "remarks", "heavy loss in w2", 4)], "ticker string, date string, speaker_role string, section string, text string, word_count int")
    assert [r.score for r in S.scored(sents, model=found.model()).collect()] == [1, -1]


def test_no_rows_and_no_validation(spark):
    rows = sentences(60)
    with pytest.raises(ValueError):
        M.fit(frame(spark, [r for r in rows if r[2] != "train"]))
    found = M.fit(frame(spark, [r for r in rows if r[2] == "train"]), buckets=64, rounds=3)
    assert found.history == [] and found.weights.any()
    none = M.predicted(spark.createDataFrame([], "text string"), found)
    assert none.count() == 0 and M.fit(frame(spark, rows).where(F.col("label") == 1), buckets=64, rounds=2).weights.shape == (65, 3)
