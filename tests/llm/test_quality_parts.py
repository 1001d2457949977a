"""The line field's features, fit and scores against plain definitions."""

import itertools

import numpy as np

from tonefold.llm import quality as Q

TEXTS = ["", "a", "Plain words here\n\nSECOND line!! | x_y 42", "the the the cat cat\n  \n| a | b |\nÉté é, ça!", "x" * 300 + " $$$ %%%\n" * 3, "🙂 🙂\n nbsp 1,2.3"]


def features(line):
    """One line's own features, character by character."""
    w = line.split()
    n = max(len(w), 1)
    kind = {"upper": 0, "letter": 0, "digit": 0, "bar": 0, "bang": 0, "symbol": 0, "rest": 0}
    for c in line:
        if ord(c) >= 0xFFFF:
            kind["rest"] += 1
        elif c.isupper():
            kind["upper"] += 1
        elif c.isalpha():
            kind["letter"] += 1
        elif c.isdigit():
            kind["digit"] += 1
        elif not c.isspace():
            kind["bar" if c == "|" else "bang" if c == "!" else "symbol" if c in "#$%&*<>=^~_{}[]\\@" else "rest"] += 1
    letters = max(kind["upper"] + kind["letter"], 1)
    return [
        kind["upper"] / letters, min(kind["bang"] / n, 2), min(kind["bar"] / n, 2), min(kind["symbol"] / n, 3), kind["digit"] / max(len(line), 1),
        sum(a == b for a, b in itertools.pairwise(w)) / n, len(set(w)) / n, np.log1p(len(w)) / 5, min(letters / n, 30) / 10, min(kind["rest"] / n, 3),
    ]


def test_features_by_character():
    own, length, n_lines = Q.line_features(TEXTS)
    lines = [x for t in TEXTS for x in t.split("\n")]
    assert n_lines.tolist() == [t.count("\n") + 1 for t in TEXTS] and len(own) == len(lines)
    for x, row, size in zip(lines, own, length, strict=True):
        assert np.allclose(row, features(x)) and size == len(x) + 1, x
    wide, at = Q.with_neighbours(own, n_lines), 0
    for k in n_lines:
        for i in range(k):
            before = own[at + i - 1] if i else np.zeros(Q.N_OWN)
            after = own[at + i + 1] if i + 1 < k else np.zeros(Q.N_OWN)
            assert np.allclose(wide[at + i], [*own[at + i], *before, *after, i == 0, i + 1 == k, 1])
        at += k


def small_corpus(seed=0):
    rnd = np.random.default_rng(seed)
    good = lambda: " ".join(rnd.choice(["river", "stone", "of", "the", "walk"], 8))
    bad = lambda: " ".join(x.upper() + "!!" for x in rnd.choice(["buy", "now", "free"], 5))
    labels = rnd.integers(0, 2, 80)
    texts = ["\n".join((good() if (y == 1) == (rnd.random() < 0.9) else bad()) for _ in range(rnd.integers(1, 6))) for y in labels]
    return texts, labels


def fitted():
    texts, labels = small_corpus()
    own, length, n_lines = Q.line_features(texts)
    return texts, labels, Q.Field.fit(own, n_lines, labels, length)


def test_scores_by_enumerating_labellings():
    texts, _, field = fitted()
    for t in [*TEXTS, *texts[:10]]:
        own, length, n_lines = Q.line_features([t])
        e = Q.with_neighbours(own, n_lines) @ field.weights
        weight = {y: np.exp(sum(a * b for a, b in zip(e, y, strict=True)) + sum(field.trans[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(e))}
        p = [sum(v for y, v in weight.items() if y[i]) / sum(weight.values()) for i in range(len(e))]
        mean = np.clip((np.array(p) * length).sum() / length.sum(), 1e-6, 1 - 1e-6)
        want = 1 / (1 + np.exp(-(field.slope * np.log(mean / (1 - mean)) + field.shift)))
        assert np.isclose(field.scores([t])[0], want)


def test_fit_is_near_the_most_likely_weights():
    texts, labels, field = fitted()
    own, _, n_lines = Q.line_features(texts)
    x, y = Q.with_neighbours(own, n_lines), np.repeat(labels, n_lines)
    scale = np.maximum(x.std(0), 0.05)
    scale[-1] = 1

    def loss(theta):
        """Negative log-likelihood a line with the penalty, path scores added up one by one."""
        w, trans = theta[:-4] / scale, theta[-4:].reshape(2, 2)
        e = x @ w
        path = (e * y).sum() + sum((n - 1) * trans[v, v] for n, v in zip(n_lines, labels, strict=True))
        return (Q.marginals(e, n_lines, trans)[2] - path) / len(x) + 1e-4 / 2 * (theta * theta).sum()

    best = np.concatenate([field.weights * scale, field.trans.ravel()])
    rnd = np.random.default_rng(1)
    assert loss(best) < 0.5 * loss(np.zeros_like(best))
    assert all(loss(best) < loss(best + rnd.normal(size=len(best))) for _ in range(30))
