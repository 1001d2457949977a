"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, sig long, token long, row long, quality_score double, _gone long, n_lines long"


def corpus(n=120, seed=3, vocabulary=400, words=(0, 120)):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        if i % 4 == 1 and out and out[-1][1]:
            w = out[rnd.randrange(len(out))][1] or "x y z"
            w = w.split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            text = " ".join(w)
        else:
            text = " ".join(rnd.choice(vocab) + rnd.choice(["", "", "", ".", "\n"]) for _ in range(rnd.randint(*words)))
        out.append((i, text))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "two words"), (None, "no id at all here"), (None, "no id at all here")]
    out += [(1006, out[0][1]), (1006, out[0][1]), (1007, "Ünï " * 300), (1008, "Ünï " * 300)]
    return out


def frame(spark, rows):
    """With columns whose names also occur inside the operators."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 0.5, 4, 5) for i, t in rows], SCHEMA)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard_links(a, b, percent):
    n = len(a & b)
    return bool(a) and bool(b) and 100 * n >= percent * (len(a) + len(b) - n)
