"""Vector codes against the rounds as they are defined, in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from tonefold.llm import codes


def by_definition(rows, parts, entries, rounds):
    """rows: vec_id, vector, label, in the order in which vectors of one vec_id count."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    q = [[max(-(1 << 25), min(1 << 25, math.floor(4096 * x))) for x in v] for _, v, _ in kept]
    small, extra = divmod(len(q[0]), parts)
    at = [k * small + min(k, extra) for k in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    books = [[cut(v)[p] for v in q[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v)[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [[best(v, p)[1] for p in range(parts)] for v in q]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v)[p] for v, h in zip(q, held, strict=True) if h[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    coded = [[best(v, p) for p in range(parts)] for v in q]
    error = [sum(d for d, _ in c) for c in coded]
    total = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in c), e, total[lab], digest) for (i, _, lab), c, e in zip(kept, coded, error, strict=True)), key=repr)


def vectors(dim, n, seed, wide=1.0):
    rnd = random.Random(seed)
    rows = [(i, [float(np.float32(rnd.gauss(0, wide))) for _ in range(dim)], rnd.choice([0, 1, 1, 1, None])) for i in range(n)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [None] * dim, 1)
    rows[7] = (7, [math.nan] * dim, None)
    rows[8] = (8, [math.inf] + [0.0] * (dim - 1), 1)
    rows[9] = (9, [0.0] * dim, 2)
    rows += [(n, rows[0][1], 0), (n, rows[0][1], 0), (n + 1, [1.0], 1), (None, rows[1][1], 1)]  # copies, another length, no vec_id
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("dim", "n", "parts", "entries", "wide"), [(16, 120, 8, 16, 0.2), (13, 60, 4, 5, 30.0), (3, 40, 8, 16, 1.0), (8, 14, 8, 16, 1e4)])
def test_codes(spark, dim, n, parts, entries, wide):
    rows = vectors(dim, n, dim, wide)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, row int, code string").repartition(3)
    got = codes.compressed(df, parts, entries, 4)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_definition(rows, parts, entries, 4)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("codes_")]


def test_few_and_empty_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, 0), (2, [math.nan], 0)], schema)).count() == 0
    one = codes.compressed(spark.createDataFrame([(4, [0.5, -0.5], None)], schema), 2).collect()
    assert [tuple(r)[:4] for r in one] == [(4, "0000", 0, 0)] and one[0].codebooks_sha256 == hashlib.sha256(b"2048,-2048").hexdigest()
    none = codes.compressed(spark.createDataFrame([(4, [], 1), (5, [], 1)], schema), 2).collect()
    assert sorted(tuple(r)[:4] for r in none) == [(4, "0000", 0, 0), (5, "0000", 0, 0)]


def test_sums_change_by_what_moves():
    rnd = np.random.default_rng(5)
    x, at = rnd.integers(-50, 50, (200, 10)).astype(np.int32), codes.cuts(10, 3)
    before, after = (rnd.integers(0, 4, (200, 3)).astype(np.uint8) for _ in "ab")
    after[:150] = before[:150]
    kept, anew, change = codes.Sums(4, at), codes.Sums(4, at), codes.Sums(4, at)
    kept.moved(x, before, None)
    anew.moved(x, after, None)
    change.moved(x, after, before)
    assert (kept.total + change.total == anew.total).all() and (kept.n + change.n == anew.n).all()
    still = codes.Sums(4, at)
    still.moved(x, after, after)
    assert not list(still.rows())


def test_distances_of_wide_integers_are_exact():
    x = np.array([[1 << 25, -(1 << 25)], [3, 4]], np.int32)
    books = [np.array([[-(1 << 25), 1 << 25], [0, 0]], np.int64)]
    code, far = codes.nearest(x, books, [0, 2])
    assert code.tolist() == [[1], [1]] and far.tolist() == [2 << 50, 25]
