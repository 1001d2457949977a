"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

A text is encoded by both, and each token is an interval of bytes. B's intervals are a static index: sorted starts and ends. Each A token asks it by bisection for the first and the
last B token that it overlaps; where no B token reaches over the gap between two A tokens, the gap is a group boundary. So groups are the least stretches that both tokenizers
cut out whole, and every A token of a group is linked to every B token of it. An id pair counts once in each document that holds it linked.

Counts are looked up by document. The most frequent id pairs, HOT at most, are sent to every executor, and the bulk of all links is theirs; links of other pairs are joined with
their counts by pair.

A is a byte-level BPE file (as in bpe.py), B a sentencepiece model that puts a blank before the text; A reads the text behind a blank. Special tokens in a text are ordinary text. Texts that
are null, empty, or that a tokenizer doesn't give back byte by byte have no tokens: zeros, and an empty digest. Texts may be of any length; a text whose groups have very many different id
pairs goes on in several rows, so none is larger than SLICE. Repeated rows are documents of their own. A null doc_id is carried along; other columns are ignored.
Of B tokens none is empty, so no two boundaries coincide and there are no ties but those of counts, which all are the highest. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_alphabet, encoder
from .common import Scratch, arrow, texts_of, tune

#: Id pairs whose counts go to every executor, at most (about 16 MB).
HOT = 1 << 18
#: Different id pairs of a row, about; and links that are expanded at once.
SLICE = 1 << 21
#: Texts with longer runs of white space are split into words by another expression engine, as the faster one gives up on them.
LONG_BLANK = regex.compile(r"\s{5000}")


class Bytes:
    """A: the byte-level BPE in a file. tiktoken merges by id, so ids have to be numbered in the order of the merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        special = {x["content"].encode() for x in spec.get("added_tokens", [])}
        raw = {t: i for t, i in raw.items() if t not in special}
        made = [bytes(alphabet[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        ids = [raw[t] for t in made]
        if ids != sorted(ids) or len(raw) != len(made) + 256 or min(ids, default=256) < 256:
            raise ValueError("the ids of the vocabulary don't follow its merges")
        self.size = max(raw.values()) + 1
        self.label = [b""] * self.size
        for t, i in raw.items():
            self.label[i] = t
        self.fast = tiktoken.Encoding("align", pat_str=PATTERN, mergeable_ranks=raw, special_tokens={})
        self.path = path

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = lambda t: np.frombuffer(encoder(self.path).ordinary(t), "<u4").tolist()
        return [slow(t) if len(t) >= 5000 and LONG_BLANK.search(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """B: a sentencepiece model with byte fallback."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.label = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.size) for p in [self.model.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class Aligner:
    """Both tokenizers, and tables of their tokens' lengths and decimal ids."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = Bytes(a), Pieces(b)
        self.a_size, self.b_size = (np.array([len(t) for t in x.label], np.int64) for x in (self.a, self.b))
        self.names = [f"{i}{end}" for n, ends in ((self.a.size, ",|"), (self.b.size, ",;")) for i in range(n) for end in ends]

    def tokens(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text; none where a tokenizer doesn't give it back."""
        plain = [t.decode() for t in texts]
        none = np.empty(0, np.int64)
        for raw, a, b in zip(texts, self.a.encode([" " + t for t in plain]), self.b.encode(plain), strict=True):
            whole = b" " + raw
            if raw and b"".join(map(self.a.label.__getitem__, a)) == whole and b"".join(map(self.b.label.__getitem__, b)) == whole:
                yield np.array(a, np.int64), np.array(b, np.int64)
            else:
                yield none, none

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each group how many tokens of A and of B end with it, from the text's start on."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        first = np.searchsorted(b_end, a_start, "right")  # B tokens are the index; each A token is a query
        last = np.searchsorted(b_start, a_end, "left") - 1
        cut = np.flatnonzero(np.append(last[:-1] < first[1:], len(a) > 0)[: len(a)])
        return cut + 1, last[cut] + 1

    def digest(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        """SHA-256 of the groups written as a1,a2|b1;a3|b2,b3."""
        if not len(a):
            return ""
        out = np.empty(len(a) + len(b), np.int64)
        for ids, ends, other, base in ((a, a_ends, np.append(0, b_ends[:-1]), 0), (b, b_ends, a_ends, 2 * self.a.size)):
            size = np.diff(ends, prepend=0)
            code = 2 * ids + base
            code[ends - 1] += 1  # the last of its group
            out[np.arange(len(ids)) + np.repeat(other, size)] = code
        return hashlib.sha256("".join(map(self.names.__getitem__, out.tolist()))[:-1].encode()).hexdigest()

    def pairs(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The different linked id pairs (a * size of B + b) and how many links each has, in slices without a pair in common; at least one slice."""
        n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        times_a, times_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        if int((n_a * n_b).sum()) > SLICE:  # ids that a group repeats are taken together first
            (a, group_a), times_a = _counted(a, group_a)
            (group_b, b), times_b = _counted(group_b, b)
        n = np.bincount(group_b, minlength=len(n_b))
        begin = np.cumsum(n) - n
        many = n[group_a]  # B tokens, or ids, that an A token, or id, is linked to
        upto = np.cumsum(many)
        start = 0
        while True:
            stop = len(a)
            if (upto[-1] if len(a) else 0) - (upto[start - 1] if start else 0) > SLICE:  # the ids of A are in order then
                stop = int(np.searchsorted(upto, SLICE + (upto[start - 1] if start else 0), "right"))
                stop = max(start + 1, stop)
                low, high = np.searchsorted(a, a[stop - 1], "left"), np.searchsorted(a, a[stop - 1], "right")
                stop = int(low) if low > start else int(high)
            m = many[start:stop]
            i = np.repeat(np.arange(start, stop), m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + begin[group_a[i]]
            pair, at = np.unique(a[i] * self.b.size + b[j], return_inverse=True)
            yield pair, np.bincount(at, times_a[i] * times_b[j], len(pair)).astype(np.int64)
            start = stop
            if start >= len(a):
                return


def _counted(first: np.ndarray, second: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The different rows of two columns in order, and how often each occurs."""
    order = np.lexsort((second, first))
    x, y = first[order], second[order]
    new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    return (x[new], y[new]), np.diff(np.append(new, len(x)))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One for each pair of files and Python process."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """docs: doc_id, text. Returns of every row doc_id, a_ids, b_ids (arrays of ids), a_ends, b_ends (how many ids of each end with a group)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both = aligner(a, b)
        for batch in batches:
            ids = list(both.tokens(texts_of(batch)))
            ends = [both.ends(x, y) for x, y in ids]
            yield {"doc_id": batch.column(0), "a_ids": [x for x, _ in ids], "b_ids": [y for _, y in ids], "a_ends": [x for x, _ in ends], "b_ends": [y for _, y in ends]}

    ints = pa.list_(pa.int64())
    types = pa.schema([("doc_id", pa.int64()), ("a_ids", ints), ("b_ids", ints), ("a_ends", ints), ("b_ends", ints)])
    return arrow(docs.select("doc_id", "text"), run, "doc_id long, a_ids array<long>, b_ids array<long>, a_ends array<long>, b_ends array<long>", types)


def linked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of every row of docs; pairs (its different id pairs, a * size of B + b) and times (links of each).
    A row's further slices of pairs have only row, pairs and times."""
    tune(docs.sparkSession)
    small = aligner(a, b).a.size * aligner(a, b).b.size < 1 << 31
    kind, ids = ("int", pa.int32()) if small else ("long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both = aligner(a, b)
        names = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            held = 0
            for row, doc_id, (x, y) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), both.tokens(texts_of(batch)), strict=True):
                e, f = both.ends(x, y)
                links = int((np.diff(e, prepend=0) * np.diff(f, prepend=0)).sum())
                head = (doc_id, len(x), len(y), len(e), links, both.digest(x, y, e, f))
                for pairs, times in both.pairs(x, y, e, f):
                    for k, v in zip(names, (row, *head, pairs, times), strict=True):
                        out[k].append(v)
                    head = (None,) * len(head)
                    held += len(pairs)
                    if held >= SLICE:
                        yield out
                        out, held = {k: [] for k in names}, 0
            yield out

    types = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(ids)), ("times", pa.list_(pa.int64()))])
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<long>"
    return arrow(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), run, schema, types)


def pair_counts(links: DataFrame, b_size: int, scratch: Scratch) -> DataFrame:
    """links: linked(). Returns pair, n (documents that hold it linked), best (whether n is the highest of its A id)."""
    counts = scratch.table(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    own = F.floor(F.col("pair") / F.lit(b_size))
    top = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    return scratch.table(counts.withColumn("a", own).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "known")


def frequent(known: DataFrame, most: int) -> int:
    """The least power of two that at most so many pairs reach with their counts."""
    sizes = {r.k: r.m for r in known.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count("*").alias("m")).collect()}  # 64 rows at most
    least = 1 << 63
    for k in range(64, 0, -1):
        most -= sizes.get(k, 0)
        if most < 0:
            break
        least = 1 << k - 1
    return least


def digests(docs: DataFrame, a: str, b: str, hot: int = HOT) -> DataFrame:
    """docs: doc_id, text. Returns of every row doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id, ties included),
    count_sum (counts of all links added up), groups_sha256."""
    scratch = Scratch(docs.sparkSession, "align")
    links = scratch.table(linked(docs, a, b), "links")
    known = pair_counts(links, aligner(a, b).b.size, scratch)
    least = frequent(known, hot)
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    often = each.join(F.broadcast(known.where(F.col("n") >= least)), "pair")  # at most `hot` rows
    if least > 1:
        rest = each.join(F.broadcast(known.where(F.col("n") >= least).select("pair")), "pair", "left_anti")
        often = often.unionByName(rest.join(known.where(F.col("n") < least), "pair"))
    sums = often.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = links.where("n_a is not null").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
