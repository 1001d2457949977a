"""Benchmark decontamination over suffix arrays of the training text.

Documents are taken together into shards of about SHARD_WORDS words. A shard's words, with a separator of its own behind each
document, get a suffix array over all positions. Every suffix of every benchmark item is searched in it by binary search, which
gives its longest verbatim match and the places of that match. An item's windows are its runs of `window` words (the whole item,
if it has fewer); where a suffix matches for a window at least, the words at those places are contaminated.

The benchmark is written to the shared folder as word hashes, in files of about BLOCK_WORDS words (a longer item
makes a longer file). Each shard is built once and held against one file after another, so a task holds one shard and one file, the driver
holds neither, and documents are read once whatever the size of the benchmark.

Words: A-Z lower-cased, then runs of digits, letters and anything beyond ASCII; they are compared by 64-bit hashes. Null and empty
texts have no words, are never contaminated and, as items, never occur. A text longer than a shard is a shard of its own.
Equal items are searched once, and of each shard every different window's places are looked up once, in slices of bounded size, however many items or suffixes have it.
Repeated rows are reported each; an empty table gives an empty table, an empty benchmark finds nothing. Items without an item_id contaminate, but aren't counted or named; items that repeat an item_id count once.
Of equally long matches the first by place counts. Other columns are kept by remove_contaminated() and ignored by the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow, texts_of
from .warc import opened

#: Words of benchmark items in a file, and of documents in a shard; bytes of a shard's texts.
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 1_000_000
SHARD_BYTES = 16 << 20
#: Places of matches that are looked at together, and items of documents that leave together, about.
SLICE = 1 << 20
_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one after another, and how many each text has."""
    w, start = hashes.of(b"\n".join(texts).lower().translate(_WORD))
    return w, np.diff(np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)])))


@dataclass
class Block:
    """Words of benchmark items, one after another; items of equal words are one. Of each word, as the first of a suffix: the item it is of, the words from
    it to the item's end, and the words that a window takes there (0 where none begins). Of each item its item_ids and its first word."""

    words: np.ndarray
    item: np.ndarray
    left: np.ndarray
    need: np.ndarray
    ids: list[list[int]]
    begin: np.ndarray


@lru_cache(maxsize=2)
def block(file: str, window: int) -> Block:
    where, path = opened(file)
    with where.open_input_file(path) as f:
        rows = pq.read_table(f)
    held: dict[bytes, set[int]] = {}
    for raw, i in zip(rows["words"].to_pylist(), rows["item_id"].to_pylist(), strict=True):
        held.setdefault(raw, set()).update(() if i is None else (i,))
    size = np.array([len(x) // 8 for x in held], np.int64)
    words = np.frombuffer(b"".join(held), np.uint64)
    item = np.repeat(np.arange(len(size)), size)
    left = np.cumsum(size)[item] - np.arange(len(words))
    least = np.minimum(window, size)[item]
    return Block(words, item, left, np.where(left >= least, least, 0), [sorted(x) for x in held.values()], np.cumsum(size) - size)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """All positions of t (numbers below 2 ** 21, if t is no longer than that), sorted by what follows, by prefix doubling; t has to end with a number that it has once."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length()) if n else 1
    depth = max(1, min(63 // bits, 3))  # so many numbers go into the first key
    padded = np.concatenate([t, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for d in range(depth):
        key = key << bits | padded[d : d + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a position's rank: where those equal so far begin
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = first, -1
    single = np.append(new[1:], True) & new
    open_ = np.flatnonzero(~single)
    while len(open_):  # only what is equal so far is sorted on
        group, then = first[open_], rank[np.minimum(order[open_] + depth, n)]
        turn = np.lexsort((then, group))
        order[open_] = order[open_][turn]
        then = then[turn]
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        first[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[order[open_]] = first[open_]
        open_ = open_[~(np.append(new[1:], True) & new)]
        depth *= 2
    return order


class Shard:
    def __init__(self, words: np.ndarray, size: np.ndarray) -> None:
        """words: of documents, one after another; size: how many each has."""
        docs = len(size)
        self.alphabet, number = np.unique(words, return_inverse=True)
        self.begin = np.cumsum(size + 1) - size - 1
        self.t = np.empty(len(words) + docs, np.int64)
        own = np.ones(len(self.t), bool)
        own[self.begin + size] = False
        self.t[own] = number + docs
        self.t[~own] = np.arange(docs)  # separators
        self.sa = suffix_array(self.t)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.t, minlength=docs + len(self.alphabet)))])
        self.docs = docs

    def search(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each suffix of the benchmark: the length of its longest match, the range of the suffix array that has it, and the range
        that matches for a window (empty, if none does). The range is narrowed word by word until it would become empty."""
        m, docs = len(b.words), self.docs
        found, lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        wlo, whi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        k = np.minimum(np.searchsorted(self.alphabet, b.words), max(len(self.alphabet) - 1, 0))
        known = self.alphabet[k] == b.words if len(self.alphabet) else np.zeros(m, bool)
        symbol = np.where(known, k + docs, -1)
        live = np.flatnonzero(known)
        lo[live], hi[live] = self.at[symbol[live]], self.at[symbol[live] + 1]
        d = 1
        while len(live):
            found[live] = d
            full = live[b.need[live] == d]
            wlo[full], whi[full] = lo[full], hi[full]
            live = live[b.left[live] > d]
            live = live[symbol[live + d] >= 0]
            want = symbol[live + d]
            start = self._edge(lo[live], hi[live], want, d)
            end = self._edge(start, hi[live], want + 1, d)
            ok = start < end
            live = live[ok]
            lo[live], hi[live] = start[ok], end[ok]
            d += 1
        return found, lo, hi, wlo, whi

    def _edge(self, a: np.ndarray, b: np.ndarray, want: np.ndarray, d: int) -> np.ndarray:
        """The first place in a..b whose suffix has, d words on, the word wanted or a later one."""
        a, b = a.copy(), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self.t[self.sa[mid] + d] < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return a

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ranges of the suffix array: number of the range, document and word of each place."""
        n = hi - lo
        k = np.repeat(np.arange(len(n)), n)
        pos = self.sa[np.repeat(lo, n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)]
        doc = np.searchsorted(self.begin, pos, "right") - 1
        return k, doc, pos - self.begin[doc]


def prepared(benchmark: DataFrame, scratch: Scratch) -> list[str]:
    """Writes the words of the items that have any; returns the files."""
    types = pa.schema([("item_id", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            w, n = words_of(texts_of(batch), hashes)
            parts = np.split(w, np.cumsum(n)[:-1]) if len(n) else []
            keep = np.flatnonzero(n)
            yield {"item_id": batch.column(0).take(pa.array(keep)), "words": [parts[i].tobytes() for i in keep]}

    items = scratch.table(arrow(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), run, "item_id long, words binary", types), "items")
    total = items.agg(F.sum(F.length("words") / 8)).first()[0]
    if not total:
        return []
    return sorted(scratch.table(items.repartition(int(-(-total // BLOCK_WORDS))), "benchmark").inputFiles())


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.RecordBatch], Shard, np.ndarray]]:
    """Batches, taken together, with the shard of their texts (of about `most` words) and the number of words of each text."""
    hashes = WordHashes()
    held: list[pa.RecordBatch] = []
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    total = 0

    def out() -> tuple[list[pa.RecordBatch], Shard, np.ndarray]:
        size = np.concatenate(sizes)
        return held, Shard(np.concatenate(words), size), size

    for batch in batches:
        texts = texts_of(batch)
        a = 0
        while a < len(texts):  # a shard ends before the text that would make it too large
            b, n = a + 1, len(texts[a])
            while b < len(texts) and n + len(texts[b]) <= SHARD_BYTES:
                n += len(texts[b])
                b += 1
            w, size = words_of(texts[a:b], hashes)
            if held and total + len(w) > most:
                yield out()
                held, words, sizes, total = [], [], [], 0
            held.append(batch.slice(a, b - a))
            words.append(w)
            sizes.append(size)
            total += len(w)
            a = b
    if held:
        yield out()


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Cuts numbers into slices of which each adds up to SLICE at most, or has one number only."""
    upto, start = np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(upto, SLICE + (upto[start - 1] if start else 0), "right")))
        yield slice(start, stop)
        start = stop


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that begin at first and have n numbers: number of the run and number, one after another."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n - first, n)


@dataclass
class Windows:
    """The different windows that a shard has, as ranges of its suffix array with their lengths; and which window each matching suffix of the benchmark begins with."""

    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    suffix: np.ndarray
    window: np.ndarray

    def places(self, shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In slices: window, document and word of every place."""
        for cut in _slices(self.hi - self.lo):
            k, doc, at = shard.places(self.lo[cut], self.hi[cut])
            yield k + cut.start, doc, at

    def items(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items that have each window: where a window's begin in a list, how many it has, and the list."""
        pairs = np.unique(self.window * len(b.ids) + b.item[self.suffix])
        n = np.bincount(pairs // len(b.ids), minlength=len(self.n))
        return np.cumsum(n) - n, n, pairs % len(b.ids)


def _windows(shard: Shard, b: Block) -> Windows:
    _, _, _, lo, hi = shard.search(b)
    full = np.flatnonzero(lo < hi)
    rows, window = np.unique(np.column_stack([lo[full], hi[full], b.need[full]]), axis=0, return_inverse=True)
    return Windows(rows[:, 0], rows[:, 1], rows[:, 2], full, window.reshape(-1))


def _longest(shard: Shard, b: Block, found: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In slices: document, and words that it and an item have in common from a place on where a window of the item stands, and not from the words before on."""
    first, n = found.lo[found.window], (found.hi - found.lo)[found.window]
    ends = b.begin[b.item] + b.left[b.begin[b.item]]  # of the item that a word is of
    symbol = np.searchsorted(shard.alphabet, b.words)
    symbol = np.where(shard.alphabet[np.minimum(symbol, len(shard.alphabet) - 1)] == b.words, symbol + shard.docs, -1) if len(shard.alphabet) else symbol
    for cut in _slices(n):
        k, at = _expanded(first[cut], n[cut])
        pos, s = shard.sa[at], found.suffix[cut][k]
        before = (s > b.begin[b.item[s]]) & (pos > 0)
        before[before] = shard.t[pos[before] - 1] == symbol[s[before] - 1]
        pos, s = pos[~before], s[~before]
        size = b.need[s].copy()
        live = np.arange(len(s))
        while len(live):
            live = live[s[live] + size[live] < ends[s[live]]]
            live = live[shard.t[pos[live] + size[live]] == symbol[s[live] + size[live]]]
            size[live] += 1
        yield np.searchsorted(shard.begin, pos, "right") - 1, size


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans (contaminated words, merged: start, end), items (sorted item_ids), longest (words of the longest run that a document and an
    item have in common, of those that hold a window; else 0), of every row of docs."""
    scratch = Scratch(docs.sparkSession, "decon")
    files = prepared(benchmark, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held, array, size in _shards(batches, shard):
            cover = np.zeros(len(array.t) + 1, np.int64)
            items: list[set] = [set() for _ in size]
            longest = np.zeros(len(size), np.int64)
            for file in files:
                b = block(file, window)
                found = _windows(array, b)
                begin, many, listed = found.items(b)
                for w, doc, at in found.places(array):
                    pos = array.begin[doc] + at
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + found.n[w], -1)
                    both = np.unique(doc * len(found.n) + w)
                    doc, w = both // len(found.n), both % len(found.n)
                    for cut in _slices(many[w]):
                        k, at = _expanded(begin[w[cut]], many[w[cut]])
                        for d, i in zip(doc[cut][k].tolist(), listed[at].tolist(), strict=True):
                            items[d].update(b.ids[i])
                for doc, n in _longest(array, b, found):
                    np.maximum.at(longest, doc, n)
            edge = np.diff(np.concatenate([[0], np.cumsum(cover) > 0, [0]]).astype(np.int8))
            a, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            doc = np.searchsorted(array.begin, a, "right") - 1
            each = np.split(np.column_stack([a, e]) - array.begin[doc][:, None], np.searchsorted(doc, np.arange(1, len(size))))
            ids = [x for batch in held for x in batch.column(0).to_pylist()]
            for cut in _slices(np.array([len(x) for x in items], np.int64)):
                yield {"doc_id": ids[cut], "n_words": size[cut], "spans": [x.tolist() for x in each[cut]], "items": [sorted(x) for x in items[cut]], "longest": longest[cut]}

    types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64())), ("longest", pa.int64())])
    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, spans array<array<long>>, items array<long>, longest long", types)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1, shard: int = SHARD_WORDS) -> DataFrame:
    """item_id, word (the first of a suffix), length (of its longest verbatim match in docs, of least words or more), doc_id, place (the first word there;
    of equally long matches that of the smallest doc_id, then the first). Of items that repeat an item_id the longest counts."""
    scratch = Scratch(docs.sparkSession, "decon-longest")
    files = prepared(benchmark, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held, array, _ in _shards(batches, shard):
            ids = [x for batch in held for x in batch.column(0).to_pylist()]
            order = np.array([-1 << 62 if x is None else x for x in ids], np.int64)
            for file in files:
                b = block(file, 1)
                found, lo, hi, _, _ = array.search(b)
                some = np.flatnonzero(found >= least)
                ranges, which = np.unique(np.column_stack([lo[some], hi[some]]), axis=0, return_inverse=True)
                first = np.zeros((len(ranges), 2), np.int64)
                for cut in _slices(ranges[:, 1] - ranges[:, 0]):
                    k, doc, at = array.places(ranges[cut, 0], ranges[cut, 1])
                    turn = np.lexsort((at, order[doc], k))
                    best = turn[np.searchsorted(k[turn], np.arange(cut.stop - cut.start))]
                    first[cut] = np.column_stack([doc[best], at[best]])
                doc, at = first[which.reshape(-1)].T
                many = np.array([max(1, len(b.ids[i])) for i in b.item[some]], np.int64)  # equal items have a row each
                for cut in _slices(many):
                    k = np.repeat(np.arange(cut.start, cut.stop), many[cut])
                    named = [x for i in b.item[some[cut]] for x in (b.ids[i] or [None])]
                    yield {"item_id": named, "word": some[k] - b.begin[b.item[some[k]]], "length": found[some[k]], "doc_id": [ids[d] for d in doc[k]], "place": at[k]}

    types = pa.schema([("item_id", pa.int64()), ("word", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
    rows = arrow(docs.select("doc_id", "text"), run, "item_id long, word long, length long, doc_id long, place long", types)
    best = rows.groupBy("item_id", "word").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "place")).alias("b"))
    return best.select("item_id", "word", (-F.col("b.less")).alias("length"), "b.doc_id", "b.place")


def digests(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return report(docs, benchmark, window, shard).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "longest")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs in which no window of a benchmark item occurs: one pass, and no shuffle."""
    scratch = Scratch(docs.sparkSession, "decon-remove")
    files = prepared(benchmark, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, array, size in _shards(batches, shard):
            keep = np.ones(len(size), bool)
            for file in files:
                for _, doc, _ in _windows(array, block(file, window)).places(array):
                    keep[doc] = False
            a = 0
            for batch in held:
                yield batch.filter(pa.array(keep[a : a + batch.num_rows]))
                a += batch.num_rows

    return docs.mapInArrow(run, docs.schema)
