"""Byte-level BPE as a tokenization automaton.

The automaton's labels are tokens; it accepts exactly the token sequences that the merge list yields. It
begins with one state in which every byte loops. Each merge (u, v) -> w, in order of rank, adds a
gadget: wherever an arc u is followed by an arc v, the state between them is split so that v can no longer
follow, and an arc w leads past both. Every arc of a label leads to one state, so states are labels: w's arc row is
a copy of v's, its column a copy of u's. Rows are compiled into ranges of the columns that they lack.

A word is encoded by transitions alone: a byte automaton tells which tokens end at a place, and the one to which an arc leads
from the state before it is taken; there is exactly one, as any prefix of an accepted sequence is itself
what the merges make of its bytes. Nothing is tried twice. Decoding emits the labels of the arcs.

Texts are split into words by the pre-tokenizer's pattern; special tokens in a text are cut out first.
A null text counts as empty: no tokens, empty decoded text. Very long texts and words take time in proportion to their bytes.
Repeated rows get a row each; nothing is ordered, so there are no ties; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow, tune

#: The split of byte-level BPE vocabularies before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: itself where printable, else from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States are labels (the token read last) and a start; the arc of a label leads to its state."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        """Compiles merges by adding a gadget for each, in order. Merges of what isn't in the vocabulary, and those that can never happen
        as their parts never meet, add none; two merges that make one token raise ValueError."""
        self.n = n = max(vocab.values()) + 1
        self.label = [b""] * n
        for t, i in vocab.items():
            self.label[i] = t
        born, left, right = [0] * n, [-1] * n, [-1] * n
        made = [len(t) == 1 for t in self.label]
        gone: dict[int, int] = {}  # arc (p, s), as p * n + s: when a gadget removed it

        def alive(p: int, s: int, when: int) -> bool:
            """Whether the arc is there before the gadget numbered when: rows and columns are followed back to what they were copied from."""
            while True:
                if gone.get(p * n + s, when) < when:
                    return False
                if not born[p] and not born[s]:
                    return True
                if born[p] > born[s]:  # p's row is a copy of its second part's
                    when, p = born[p], right[p]
                else:  # s was added beside its first part, in states split already
                    when, s = born[s] + 1, left[s]

        gadgets: list[tuple[int, int, int]] = []
        for rank, (u, v) in enumerate(merges, 1):
            a, b, w = vocab.get(u, -1), vocab.get(v, -1), vocab.get(u + v, -1)
            if min(a, b, w) < 0 or not (made[a] and made[b] and alive(a, b, rank)):
                continue
            if made[w]:
                raise ValueError(f"two merges make {u + v!r}")
            born[w], left[w], right[w], made[w] = rank, a, b, True
            gone[a * n + b] = rank
            gadgets.append((a, b, rank))
        self._rows(gadgets, born, left, right)
        self._words([t for t in range(n) if made[t]])
        self.arcs: dict[int, bool] = {}

    def _rows(self, gadgets: list[tuple[int, int, int]], born: list[int], left: list[int], right: list[int]) -> None:
        """The arc rows of all states. Rows that were copied from a's after a gadget removed its arc b lack the arc, and so do the columns
        copied from b's; with copies numbered next to what they were copied from, youngest first, both are ranges of numbers.
        Each row holds the ranges of columns that it lacks; all rows stand in one ascending array of row * n + column."""
        row, rows = _numbered(right, born)
        col, cols = _numbered(left, born)
        lacks = [(row[a], rows(a, k + 1), col[b], cols(b, k)) for a, b, k in gadgets]
        first, many, start, width = (np.array(x, np.int64) for x in zip(*lacks, strict=True)) if lacks else [np.empty(0, np.int64)] * 4
        each = np.repeat(np.arange(len(many)), many)
        at = (first[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)) * self.n + start[each]
        order = np.argsort(at, kind="stable")
        at, end = at[order], np.maximum.accumulate((at + width[each])[order])
        new = np.ones(len(at), bool)
        new[1:] = at[1:] > end[:-1]
        last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
        self.bounds = array("q", np.column_stack([at[new], end[last] if len(at) else end]).tobytes())
        self.row, self.col = [r * self.n for r in row], col

    def _words(self, tokens: list[int]) -> None:
        """The transitions over bytes: a state for each beginning of a token, the longest token that ends there, and after it the next shorter one."""
        self.go: dict[int, int] = {}
        at, parent, letter, node_of = [-1], [0], [0], {}
        for t in tokens:
            node = 0
            for byte in self.label[t]:
                if (to := self.go.get(node << 8 | byte)) is None:
                    to = self.go[node << 8 | byte] = len(at)
                    at.append(-1)
                    parent.append(node)
                    letter.append(byte)
                node = to
            at[node], node_of[t] = t, node
        depth = [0] * len(at)
        for x in range(1, len(at)):
            depth[x] = depth[parent[x]] + 1
        self.back, longest, own = [0] * len(at), [-1] * len(at), dict(self.go)
        for x in sorted(range(1, len(at)), key=depth.__getitem__):
            if parent[x]:
                f = self.back[parent[x]]
                while f and (f << 8 | letter[x]) not in own:
                    f = self.back[f]
                self.back[x] = own.get(f << 8 | letter[x], 0)
            longest[x] = at[x] if at[x] >= 0 else longest[self.back[x]]
        self.longest = longest
        self.shorter = [-1] * self.n
        for t, x in node_of.items():
            self.shorter[t] = longest[self.back[x]]
        self.size = [len(t) for t in self.label]

    def _step(self, node: int, byte: int) -> int:
        """An entry of the byte transitions that follows from others; kept from then on."""
        x = node
        while (to := self.go.get(x << 8 | byte)) is None and x:
            x = self.back[x]
        to = to or 0
        if len(self.go) < 4_000_000:
            self.go[node << 8 | byte] = to
        return to

    def arc(self, p: int, s: int) -> bool:
        """The transition table: whether s may follow p."""
        return not bisect_right(self.bounds, self.row[p] + self.col[s]) & 1

    def run(self, word: bytes) -> list[int]:
        """The token ids of a word: the labels of its one accepting path.

        What precedes any place on the path is the path of the bytes before it, so one token ends at each place: of the tokens that
        end there the one to which an arc leads from the state that stands before it. Bytes are read once, from left to right.
        """
        n, go, longest, shorter, size, arcs = self.n, self.go, self.longest, self.shorter, self.size, self.arcs
        last = [-1] * (len(word) + 1)
        node = 0
        for i, byte in enumerate(word, 1):
            if (to := go.get(node << 8 | byte)) is None:
                to = self._step(node, byte)
            node = to
            t = longest[node]
            while (p := last[i - size[t]]) >= 0:
                if (ok := arcs.get(p * n + t)) is None:
                    if len(arcs) > 2_000_000:
                        arcs.clear()
                    ok = arcs[p * n + t] = self.arc(p, t)
                if ok:
                    break
                t = shorter[t]
            last[i] = t
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= size[last[i]]
        return out[::-1]


def _numbered(parent: list[int], born: list[int]) -> tuple[list[int], Callable[[int, int], int]]:
    """A number for each node, ahead of its children's, younger children first; and a function of a node and a time: how many numbers from
    the node's on belong to it and to what descends from its children born then or later."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for t in sorted(range(n), key=born.__getitem__):
        if parent[t] >= 0:
            kids[parent[t]].append(t)
    number, seen, stack = [0] * n, [], [t for t in range(n) if parent[t] < 0]
    while stack:
        t = stack.pop()
        number[t] = len(seen)
        seen.append(t)
        stack += kids[t]  # the youngest is taken next
    size = [1] * n
    for t in reversed(seen):
        if parent[t] >= 0:
            size[parent[t]] += size[t]
    return number, lambda t, when: 1 + sum(size[c] for c in kids[t] if born[c] >= when)


class _Words(dict):
    """Packed ids (unsigned 32-bit, little-endian as Spark's platforms are) of text pieces; prefix: what stands before each piece."""

    def __init__(self, auto: Automaton, prefix: str, most: int) -> None:
        super().__init__()
        self.auto, self.prefix, self.most, self.split = auto, prefix, most, regex.compile(PATTERN)
        self.rest: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the words before; those met again come back

    def _rest(self, word: str) -> bytes:
        """Of words that don't begin with a blank."""
        if len(self.rest) >= self.most // 4:
            self.rest.clear()
        out = self.rest[word] = array("I", self.auto.run(word.encode())).tobytes()
        return out

    def __missing__(self, piece: str) -> bytes:
        if (out := self.old.get(piece)) is None:
            out = self._encoded(piece)
        if len(piece) <= 64:
            if len(self) >= self.most // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def _encoded(self, piece: str) -> bytes:
        words, run = self.split.findall(self.prefix + piece), self.auto.run
        if len(words) == 1:
            out = array("I", run(words[0].encode())).tobytes()
        else:
            out = b""
            for word in words:
                if word[0] == " " and self.prefix and len(word) > 1:  # also found as a piece of its own
                    if (known := self.get(word[1:]) or self.old.get(word[1:])) is None:
                        known = self[word[1:]] = array("I", run(word.encode())).tobytes()
                    out += known
                else:
                    out += self.rest.get(word) or self._rest(word)
        return out


#: A blank beside another white-space character, or at an end of the text; elsewhere a blank always begins a word.
_TIGHT = re.compile(r" \s|\s |^ | $")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Reads a tokenizer file (vocab, merges, added tokens of a byte-level BPE). words: how many words are remembered; a Python process keeps its encoder
    beside what the tasks after it need, so words that weren't met for long are forgotten."""

    def __init__(self, path: str, words: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.auto = Automaton(vocab, [(raw(a), raw(b)) for a, b in pairs])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.label = list(self.auto.label) + [b""] * max(0, max(self.special.values(), default=-1) + 1 - len(self.auto.label))
        for t, i in self.special.items():
            self.label[i] = t.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first, self.later = _Words(self.auto, "", words // 4), _Words(self.auto, " ", words)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = _CUT.split(text) if _TIGHT.search(text) else text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, one after another."""
        if self.cut is None or not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if k % 2 else self._plain(x) for k, x in enumerate(self.cut.split(text)))

    def ordinary(self, text: str) -> bytes:
        """As encode(), but special tokens in the text are ordinary text."""
        return self._plain(text)

    def decode(self, packed: bytes) -> bytes:
        """The labels of the ids, as UTF-8; bytes that are no character become U+FFFD."""
        out = b"".join(map(self.label.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return out.decode("utf-8", "replace").encode()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids (array of int), n_tokens, of every row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(path)
        for batch in batches:
            packed = [enc.encode(x or "") for x in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in packed], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
            yield {"doc_id": batch.column(0), "ids": ids, "n_tokens": n}

    types = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())])
    return arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, n_tokens long", types)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded: doc_id, ids. Returns doc_id, text; null ids give an empty text."""
    tune(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(path)
        for batch in batches:
            yield {"doc_id": batch.column(0), "text": [enc.decode(np.array(x or [], "<u4").tobytes()).decode() for x in batch.column(1).to_pylist()]}

    return arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, so ids needn't leave Python."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc, sha = encoder(path), hashlib.sha256
        for batch in batches:
            packed = [enc.encode(x or "") for x in batch.column(1).to_pylist()]
            yield {
                "doc_id": batch.column(0),
                "n_tokens": [len(x) // 4 for x in packed],
                "ids_sha256": [sha(x).hexdigest() for x in packed],
                "decoded_sha256": [sha(enc.decode(x)).hexdigest() for x in packed],
            }

    types = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", types)
