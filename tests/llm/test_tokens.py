"""BPE against the tokenizers library, token counts, WARC packages."""

import base64
import hashlib
import io
import zipfile

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tonefold.llm import bpe, tokens, warc

from .helpers import corpus, frame

PATH = P.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n'sdt1é<|endoftext|>", max_size=60)))
def test_encode_is_the_librarys(text):
    packed = bpe.encoder(PATH).encode(text)
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert bpe.encoder(PATH).decode(packed).decode() == REFERENCE.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "<|endoftext|>", "a <|endoftext|> b", "aaaa" * 400, "\x1c\x85 x", "don't 'LL we've", "🙂é" * 50])
def test_odd_texts(text):
    assert np.frombuffer(bpe.encoder(PATH).encode(text), "<u4").tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


def test_arcs_of_a_small_automaton():
    vocab = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    auto = bpe.Automaton(vocab, [(b"a", b"a"), (b"a", b"b"), (b"a", b"ab")])
    a, b, aa, ab, aab = range(5)
    assert not auto.arc(a, a) and not auto.arc(a, b) and not auto.arc(a, aa)
    assert auto.arc(aa, a) and auto.arc(aa, aa) and auto.arc(b, ab) and auto.arc(aa, ab)
    assert auto.run(b"aaab") == [aa, ab] and auto.run(b"aab") == [aa, b] and auto.run(b"aaaa") == [aa, aa]


def gadgets(n, merges):
    """The definition on whole rows: split the state between, let the new label past it."""
    rows = {i: set(range(n)) for i in range(n)}
    for w, (u, v) in enumerate(merges, n):
        rows[w] = set(rows[v])
        rows[u].discard(v)
        for p in rows:
            if u in rows[p]:
                rows[p].add(w)
    return rows


def merged(word, merges, n):
    out = list(word)
    for w, (u, v) in enumerate(merges, n):
        i = 0
        while i + 1 < len(out):
            if (out[i], out[i + 1]) == (u, v):
                out[i : i + 2] = [w]
            i += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_compiled_rows_are_those_of_the_gadgets(seed):
    rnd = np.random.default_rng(seed)
    n, label, merges = 3, [b"a", b"b", b"c"], []
    while len(merges) < 25:  # as merges are learnt: of tokens that meet in a text, each making a new token
        text = merged(rnd.integers(0, n, 400).tolist(), merges, n)
        i = int(rnd.integers(0, len(text) - 1))
        if label[text[i]] + label[text[i + 1]] not in label:
            merges.append((text[i], text[i + 1]))
            label.append(label[text[i]] + label[text[i + 1]])
    auto = bpe.Automaton({t: i for i, t in enumerate(label)}, [(label[u], label[v]) for u, v in merges])
    want = gadgets(n, merges)
    assert all(auto.arc(p, s) == (s in want[p]) for p in range(len(label)) for s in range(len(label)))
    for _ in range(50):
        word = rnd.integers(0, n, int(rnd.integers(1, 40))).tolist()
        assert auto.run(bytes(97 + x for x in word)) == merged(word, merges, n)


def test_a_merge_that_never_happens():
    vocab = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    assert bpe.Automaton(vocab, [(b"a", b"a"), (b"aa", b"b"), (b"aa", b"b")]).run(b"aab") == [4]  # the second never happens


def test_digests_and_round_trip(spark):
    rows = corpus(20)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame(spark, rows), PATH).collect()}
    want = set()
    for i, t in rows:
        ids = REFERENCE.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    back = bpe.decode(bpe.encode(frame(spark, rows), PATH), PATH)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


@pytest.mark.parametrize("block", [16, 4096])
def test_token_counts(spark, block):
    rows = [*corpus(30), (5000, "x<|endoftext|>y"), (5001, "long text. " * 20_000)]
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    got = tokens.counted(frame(spark, rows), PATH, 50256, block)
    want = sorted(((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert tokens.counted(frame(spark, []), PATH, 50256).count() == 0


def test_unfinished_files(spark, tmp_path):
    files = []
    for name, ids in (("a", [1, 2, 9, 9, 3]), ("b", [9]), ("c", []), ("d", [4] * 50)):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        files.append((str(tmp_path / name), 2 * len(ids)))
    got = tokens.count(spark.createDataFrame(files, "file string, size long"), 9, 2, 8)
    assert sorted((r.file[-1], r.ordinal, r.n_tokens, r.finished) for r in got.collect()) == [("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 1, False), ("b", 0, 0, True), ("d", 0, 50, False)]


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, "http://c\r\n", None), (4, None, ""), (5, "http://e", "é" * 70_000), (6, "u", "WARC/1.0\r\n\r\nPK\x05\x06"), (6, "u", "other"), (None, "n", "<p>x</p>")]


@pytest.mark.parametrize("least", [0, 9])
def test_warc_round_trip(spark, least):
    rows = warc.round_trip(spark, spark.createDataFrame(PAGES, "page_id long, url string, html string"), least).collect()
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        best = max((p for p, _, x in PAGES if (x or "") == (h or "") and p is not None), default=None)
        again = len(raw) >= least and best != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", best if again else None))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class _Bytes(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("wide", [False, True])
def test_directories(wide, monkeypatch):
    if wide:  # every field saturates: ZIP64 records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = _Bytes()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr("archive/a.warc", b"x" * 100)
        z.writestr("é.txt", b"second, PK\x05\x06 inside")
        z.comment = b"note PK\x05\x06 note"
    pack = warc.Package(out, len(out.getvalue()))
    assert pack.member("archive/a.warc") == b"x" * 100
    assert pack.member("é.txt") == b"second, PK\x05\x06 inside"
    with pytest.raises(ValueError, match="central directory"):
        warc.Package(_Bytes(b"no archive"), 10)
