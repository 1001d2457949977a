"""N-gram components, line dedup and embedding links against brute force."""

import math
import random

import numpy as np
import pytest

from tonefold.llm import embed, lines, ngram
from tonefold.llm.components import components
from tonefold.llm.common import Scratch
from tonefold.llm.setjoin import Rule, overlaps

from .helpers import corpus, frame, jaccard_links, shingles


def classes(n, linked):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 128), (5, 80, 3)])
def test_components(spark, k, percent, block):
    rows = corpus()
    sets = [shingles(t, k) for _, t in rows]
    roots = classes(len(rows), lambda a, b: jaccard_links(sets[a], sets[b], percent))
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = sorted(((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, roots, strict=True)), key=repr)
    got = ngram.components(frame(spark, rows), k, percent, block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_documents_without_an_id_do_not_name_a_component(spark):
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (None, "x y z"), (9, "other words here")]
    got = sorted((tuple(r)[::2] for r in ngram.components(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 7), (7, 7), (None, None), (9, 9)], key=repr)


def test_keep_first(spark):
    rows = corpus()
    df = frame(spark, rows)
    kept = ngram.keep_first(df)
    assert kept.columns == df.columns
    found = {r.doc_id: r.component_id for r in ngram.components(df).collect()}
    want = sorted((i for i, _ in rows if i is None or found[i] == i), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_empty_tables(spark):
    df = frame(spark, [])
    assert ngram.components(df).count() == 0
    assert lines.dedup(df).count() == 0
    assert embed.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def removed(rows, k=5, percent=80):
    """By the definition: a line goes if an earlier one has a Jaccard of at least 0.8."""
    seen, out = [], {}
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))  # rows of one doc_id have one text
    for i, t in order:
        for j, ln in enumerate(t.split("\n")):
            s = shingles(ln, k)
            if s and any(jaccard_links(s, x, percent) for x in seen):
                out.setdefault(i, set()).add(j)
            if s:
                seen.append(s)
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_line_dedup(spark, block):
    rows = [(i, None if t is None else "\n".join(" ".join(t.split()[a : a + 12]) for a in range(0, max(1, len(t.split())), 12))) for i, t in corpus(80)]
    df = frame(spark, rows)
    got = lines.dedup(df, block=block)
    assert got.columns == [*[c for c in df.columns if c != "n_lines"], "n_lines", "n_removed", "n_left"]
    gone = removed(rows)
    want = []
    for i, t in rows:
        parts = [] if t is None else t.split("\n")
        kept = [x for j, x in enumerate(parts) if j not in gone.get(i, ())]
        want.append((i, None if t is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_rows_of_one_doc_id_keep_their_own_lines(spark):
    rows = [(None, "a b c d e f\nunique one"), (None, "a b c d e f\nunique two"), (5, "a b c d e f\nunique three"), (5, "unique four\na b c d e f")]
    got = lines.dedup(frame(spark, rows)).collect()
    assert sum(r.n_removed for r in got) == 3  # the common line stays once, in a row without a doc_id
    assert sorted(x for r in got for x in r.text.split("\n") if x.startswith("unique")) == ["unique four", "unique one", "unique three", "unique two"]
    assert sum("a b c" in r.text for r in got if r.doc_id is None) == 1


def test_large_groups_elect_a_leader(spark):
    rnd = random.Random(30)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # most are close to the first, some only to each other
        w = list(base)
        for _ in range(i % 9):
            w[rnd.randrange(60)] = f"n{rnd.randrange(500)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 5) for _, t in rows]
    roots = classes(len(rows), lambda a, b: jaccard_links(sets[a], sets[b], 80))
    for block in (4, 16):
        got = {r.doc_id: r.component_id for r in ngram.components(frame(spark, rows), 5, 80, block).collect()}
        assert got == {i: roots[i] for i in range(150)}
    gone = removed(rows)
    assert {r.doc_id for r in lines.dedup(frame(spark, rows), block=8).where("n_removed > 0").collect()} == set(gone)


def test_strip_drops_documents_without_lines(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f", 11), (2, "a b c\nd e f", 11), (3, "", 0), (4, "d e f\nnew line here", 21)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.strip(df).collect()}
    assert got == {1: ("a b c\nd e f", 11), 3: ("", 0), 4: ("new line here", 13)}


def test_overlaps_counts():
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40)).astype(np.uint64)) for _ in range(30)] + [np.arange(5, dtype=np.uint64)] * 12
    want = [[len(np.intersect1d(a, b)) for b in sets[:20]] for a in sets]
    assert overlaps(sets, sets[:20]).tolist() == want
    assert Rule().words == 5 and Rule().percent == 80


def test_embeddings(spark):
    rnd = random.Random(1)
    rows, nan = [], math.nan
    for i in range(150):
        base = rows[rnd.randrange(len(rows))][1] if rows and i % 3 else None
        v = [x + rnd.gauss(0, 0.03 * rnd.random()) for x in base] if base and len(base) == 16 and all(x is not None for x in base) else [rnd.gauss(0, 1) for _ in range(16)]
        rows.append((i, v, rnd.randrange(3)))
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [nan] * 16, 0), (204, [None] * 16, 0), (205, rows[0][1], None), (206, rows[0][1], rows[0][2]), (206, rows[0][1], rows[0][2]), (207, [math.inf] * 16, 1), (208, [1.0, 0.0], 1), (209, [2.0, 0.0], 1)]

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(float)
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v, _ in rows]
    linked = lambda a, b: rows[a][2] is not None and rows[a][2] == rows[b][2] and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= 0.98
    roots = classes(len(rows), linked)
    want = []
    for a, (i, _, _) in enumerate(rows):
        comp = min(rows[b][0] for b in range(len(rows)) if roots[b] == roots[a])
        want.append((i, sum(linked(a, b) for b in range(len(rows)) if b != a), comp, i == comp))
    got = embed.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_recall_of_pairs_at_the_threshold(spark, dim):
    """Codes are made for some hundred thousand vectors; the pairs, of cosine 0.98 to 0.99, have to meet in a piece."""
    rnd = np.random.default_rng(dim)
    x = rnd.standard_normal((4000, dim)) * np.linspace(2, 0.5, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rnd.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rnd.uniform(0.98, 0.99, (4000, 1))
    width, n = embed.shape(300_000, 0.98)
    codes = embed.Codes(x[:2000], dim, width, n)
    differ = np.bitwise_count(codes.pieces(x) ^ codes.pieces(c * x + np.sqrt(1 - c * c) * y))
    assert width >= 28 and (differ.min(1) <= 2).mean() >= 0.99
    near = embed.near(spark.createDataFrame([(2 * i + k, v.tolist(), 0) for i in range(200) for k, v in enumerate((x[i], (c * x + np.sqrt(1 - c * c) * y)[i]))], "vec_id long, embedding array<double>, label int"))
    assert near.where("n_links > 0").count() >= 0.99 * 400


@pytest.mark.parametrize(("common", "skewed"), [(4, True), (40, False), (1 << 16, True)])
def test_postings_meet(monkeypatch, common, skewed):
    """Every item of a token that others have comes out with a first one, whether the token is common in a task or not. Ids are 64 bits wide; where
    the tokens aren't skewed, shares are large and none of their tokens is common."""
    import pyarrow as pa

    from tonefold.llm import blocks

    monkeypatch.setattr(blocks, "COMMON", common)
    monkeypatch.setattr(blocks, "COLLECTED", 100)
    rnd = np.random.default_rng(3)
    ids = rnd.integers(-(2**63), 2**63 - 1, 200)
    tokens = rnd.integers(-(2**63), 2**63 - 1, 97)
    drawn = (lambda: rnd.zipf(1.6, 60).astype(np.int64) % 97) if skewed else (lambda: rnd.integers(0, 97, 60))
    parts = [(tokens[drawn()], ids[rnd.integers(0, 200, 60)]) for _ in range(12)]
    rows = [r for task in (parts[:7], parts[7:]) for r in blocks.Postings(3 << 19).dealt(iter(task))]
    batch = pa.RecordBatch.from_arrays([pa.array([x for r in rows for x in r[f.name]], f.type) for f in blocks.Postings.TYPES], schema=blocks.Postings.TYPES)
    batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
    got = {}
    for out in blocks._met(iter([batch.slice(0, 5), batch.slice(5)])):
        for t, e, f in zip(*(np.asarray(out[k]).tolist() for k in ("token", "ent", "first")), strict=True):
            got.setdefault(t, set()).add(e)
            assert f in set(ids.tolist())
    held = {}
    for t, e in parts:
        for a, b in zip(t.tolist(), e.tolist(), strict=True):
            held.setdefault(a, set()).add(b)
    assert got == {t: e for t, e in held.items() if len(e) > 1}


def test_embedding_links_of_one_large_task(spark):
    """So many postings in one task that its shares are large, of tokens none of which is common: each pair is found."""
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rnd.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, 0.99 * x + np.sqrt(1 - 0.99**2) * y])
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int").coalesce(1)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near(rows).collect()}
    assert got == {i: (1, i % 1500) for i in range(3000)}


def near_pairs(n, seed):
    """Texts of 60 words, and of each another with one word changed (Jaccard of 5-word shingles about 0.83)."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(20_000)]
    texts = [[rnd.choice(vocab) for _ in range(60)] for _ in range(n)]
    other = [[*t[:30], "changed", *t[31:]] for t in texts]
    return [" ".join(t) for t in texts + other]


def test_set_joins_of_one_large_task(spark):
    """As above, for documents and for lines: over 65,536 postings in one task."""
    n = 5000
    rows = list(enumerate(near_pairs(n, 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in ngram.components(df).collect()} == {i: i % n for i in range(2 * n)}
    assert {r.doc_id for r in lines.dedup(df).where("n_removed = 1").collect()} == set(range(n, 2 * n))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 8), (200, 150)], "u long, v long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 150: 150, 200: 150}
