"""Alignment of two tokenizers against the definition, by the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tonefold.llm import align

from .helpers import corpus, frame

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
AWKWARD = [
    None, "", " ", "  two  blanks ", "<|endoftext|> is text here", "<s></s><unk>", "naïve café 東京タワー 🙂🙂 ﬁne", "tab\tnewline\n\n  indented\r\n", "a" * 3000, "ab" * 4000,
    "0123456789abcdef" * 300, " " * 9000 + "x", "\n" * 40, "\x00\x01 control", "▁▁ literal", "don't  we'll THEY'RE", "é combining",
]


@cache
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """Ids and byte lengths by the libraries, or nothing."""
    if not text:
        return [], [], [], []
    t, sp = libraries()
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    x = [bytes(chars[c] for c in t.id_to_token(i)) for i in a]
    y = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
    return (a, b, x, y) if b"".join(x) == b"".join(y) == (" " + text).encode() else ([], [], [], [])


def by_definition(rows):
    cut, count = [], Counter()
    for _, text in rows:
        a, b, x, y = tokens(text)
        ends = [list(np.cumsum([len(t) for t in z])) for z in (x, y)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [tuple([i for i, e in zip(ids, at, strict=True) if low < e <= high] for ids, at in ((a, ends[0]), (b, ends[1]))) for low, high in zip([0, *both][: len(both)], both, strict=True)]
        pairs = Counter((i, j) for g, h in groups for i in g for j in h)
        count.update(pairs.keys())
        cut.append((len(a), len(b), groups, pairs))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups, pairs) in zip(rows, cut, strict=True):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(k for (i, j), k in pairs.items() if count[i, j] == top[i])
        out.append((doc_id, n_a, n_b, len(groups), sum(pairs.values()), best, sum(k * count[p] for p, k in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [align.HOT, 40, 0])
def test_alignment(spark, hot):
    rows = corpus(60) + [(3000 + i, t) for i, t in enumerate(AWKWARD)]
    got = align.digests(frame(spark, rows), A, B, hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_definition(rows)


@pytest.mark.parametrize("most", [1, 3, 20, 1000])
def test_slices_hold_each_pair_once(monkeypatch, most):
    monkeypatch.setattr(align, "SLICE", most)
    al = align.aligner(A, B)
    rnd = np.random.default_rng(most)
    for _ in range(20):
        k = int(rnd.integers(1, 5))
        a_ends, b_ends = (np.cumsum(rnd.integers(1, 12, k)) for _ in "ab")
        a, b = rnd.integers(0, 6, a_ends[-1]), rnd.integers(0, 6, b_ends[-1])
        want = Counter()
        for g in range(k):
            x, y = (ids[(e[g - 1] if g else 0) : e[g]].tolist() for ids, e in ((a, a_ends), (b, b_ends)))
            want.update((i, j) for i in x for j in y)
        got = [(divmod(p, al.b.size), t) for pairs, times in al.pairs(a, b, a_ends, b_ends) for p, t in zip(pairs.tolist(), times.tolist(), strict=True)]
        assert len(dict(got)) == len(got) and dict(got) == want


def test_groups_join_to_the_text(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(30))]
    al = align.aligner(A, B)
    for r in align.groups(frame(spark, rows), A, B).collect():
        x, y = (b"".join(al_.label[i] for i in ids) for al_, ids in ((al.a, r.a_ids), (al.b, r.b_ids)))
        assert x == y == ((" " + rows[r.doc_id][1]).encode() if rows[r.doc_id][1] else b"")
        for e, f in zip(r.a_ends, r.b_ends, strict=True):
            assert b"".join(al.a.label[i] for i in r.a_ids[:e]) == b"".join(al.b.label[i] for i in r.b_ids[:f])


def test_empty_table(spark):
    assert align.digests(frame(spark, []), A, B).count() == 0


def test_frequent(spark):
    known = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 2, 3, 4, 9])], "pair int, n long")
    assert [align.frequent(known, k) for k in (0, 1, 2, 3, 4, 6)] == [16, 8, 4, 4, 2, 1]
