"""Substring dedup by collinear chaining.

1. Seeds are hashes of runs of K words; of WINDOW in a row the least is one, so equal runs of K + WINDOW - 1 words share a seed.
   Each is joined to the first document that has it, by doc_id, or to its last occurrence in the same document: rows grow with the documents, not with their pairs.
2. A document's matches that touch on one diagonal are joined to equal runs. Where fewer than PAIRED words of runs with one other document, or SEEDED
   with all, stand together, or too few words for a passage, they are let go. The runs that a document shares with one other are chained: a Fenwick tree over the places in the other gives each run its best
   predecessor among all before it in both texts, less a cost for every word between (chains()).
3. Chains are cut at gaps of more than MOST_GAP words. The words of the other gaps, and EDGE words beyond both ends, are fetched from
   both texts; texts themselves aren't joined. Gaps are aligned by their longest common subsequence, ends by a banded alignment, and
   a chain that isn't equal enough as a whole is cut into the longest parts that are (aligned()).
4. What alignments of SHORTEST words or more cover is merged; passages of at least `least` words are repeats.

The first occurrence of a passage, by (doc_id, word), is never marked. Words are runs outside [\\x20\\x09-\\x0D], A-Z
lower-cased. Null and empty texts and texts of fewer than K words have no passages; texts may be of any length; an empty table gives an empty table. Rows that
repeat a doc_id and a text count as one document, rows of one doc_id with different texts as documents of their own, in order of hashes of their texts; rows without a doc_id come before all others. Ties: of predecessors of equal worth the first counts, of
chains of equal score the first in the text. Other columns, whatever their names, are ignored by passages() and kept by without_repeats().
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow, changes, mixed, spread, texts_of, wide, whole

K, WINDOW = 4, 3
#: Words that the runs of a stretch have together at least, those that two documents share and all: fewer are phrases that meet by chance.
PAIRED, SEEDED = 8, 12
#: Words that an alignment has at least: shorter ones are stock phrases.
SHORTEST = 6
#: Words that a gap in a chain may skip on either side; cost of a word between two runs, on either side, against 1 for a matched one.
MOST_GAP, GAP_COST = 40, 0.25
#: Words beyond either end of a chain that an alignment may take in.
EDGE = 24
#: Share of the words of an alignment that must be equal; the same as points, that have to balance, for an equal word and for another.
IDENTITY = 0.8
SCORE, LOSS = 1, 4
#: Unequal words that one gap of an alignment may have.
UNEQUAL = 8
#: Of an alignment beyond the ends of a chain: words that one side may be ahead, points that it may fall back.
BAND, DROP = 2, 8
#: Requests for words of one text that one task answers; a text with more goes to several.
ASKED = 512

Runs = list[tuple[int, int, int]]


def seeds(ids: np.ndarray, doc: np.ndarray, factor: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the seeds of word sequences that stand one after another; doc: which sequence each word is of."""
    n = len(ids) - K + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        h = mixed(sum(ids[j : n + j] * factor[j] for j in range(K)))
    ok = doc[:n] == doc[K - 1 :]
    h[~ok] = most
    padded = np.append(h, np.full(window - 1, most))
    least, at = h.copy(), np.arange(n)
    for j in range(1, window):
        less = padded[j : n + j] < least
        least[less] = padded[j : n + j][less]
        at[less] = np.flatnonzero(less) + j
    taken = np.zeros(n, bool)
    taken[at[ok]] = True
    at = np.flatnonzero(taken)
    return h[at], at


def anchors(doc: np.ndarray, first: np.ndarray, here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal runs (doc, first, word here, word there, length) of matches: those of one diagonal that overlap or touch are one. By doc, first and place."""
    order = np.lexsort((here, here - there, first, doc))
    d, f, x, y = doc[order], first[order], here[order], there[order]
    new = changes(d, f, x - y)
    new[1:] |= np.diff(x) > K
    a = np.flatnonzero(new)
    n = x[np.append(a[1:], len(x)) - 1] - x[a] + K if len(a) else a
    order = np.lexsort((y[a], x[a], f[a], d[a]))
    a, n = a[order], n[order]
    return d[a], f[a], x[a], y[a], n


def dense(group: np.ndarray, x: np.ndarray, n: np.ndarray, seeded: int, span: int) -> np.ndarray:
    """Which runs stand in a stretch of their group (ascending numbers), of runs at most MOST_GAP words apart, that is span words long and in which runs have seeded words together."""
    order = np.lexsort((x, group))
    g, a, b = group[order], x[order], x[order] + n[order]
    base = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1])])) << 40  # beyond any text, so that one running maximum serves all groups
    top = np.maximum.accumulate(b + base)
    new = np.ones(len(g), bool)
    new[1:] = a[1:] + base[1:] > top[:-1] + MOST_GAP
    start = np.flatnonzero(new)
    fresh = np.maximum(b + base - np.maximum(a + base, np.concatenate([[0], top[:-1]])), 0)  # words that no run before covers
    length = top[np.append(start[1:], len(g)) - 1] - (a + base)[start]
    good = (np.add.reduceat(fresh, start) >= seeded) & (length >= span)
    out = np.zeros(len(g), bool)
    out[order] = np.repeat(good, np.diff(np.append(start, len(g))))
    return out


def chains(parts: Runs) -> list[Runs]:
    """Chains of equal runs (word here, word there, length; ordered) that follow each other in both texts; each run is in one chain.

    A chain's score is the length of its runs, less GAP_COST for each word, here and there, from K - 1 words before a run's end to the
    next run's start: so much two runs may overlap. The cost is a sum of what either end gives, so the best predecessor is a prefix maximum, over the
    places there, among runs that end before here; it is exact, and no limit of distance hides a near run behind a far one.
    """
    m = len(parts)
    if m == 1:
        return [parts]
    ends = [(x + n - K + 1, y + n - K + 1) for x, y, n in parts]
    places = sorted({v for _, v in ends})
    tree: list[tuple[float, int]] = [(-1e18, 0)] * (len(places) + 1)  # worth of a run as a predecessor, and minus its number
    score, back = [0.0] * m, [-1] * m
    waiting = sorted(range(m), key=lambda p: ends[p][0])
    k = 0
    for i, (x, y, n) in enumerate(parts):
        while k < m and ends[waiting[k]][0] <= x:  # they begin before x, so their scores are known
            p = waiting[k]
            k += 1
            worth = (score[p] + GAP_COST * (ends[p][0] + ends[p][1]), -p)
            at = bisect_right(places, ends[p][1])
            while at < len(tree):
                if tree[at] < worth:
                    tree[at] = worth
                at += at & -at
        best, at = (-1e18, 0), bisect_right(places, y)
        while at:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        gain = best[0] - GAP_COST * (x + y)
        score[i], back[i] = (n + gain, -best[1]) if gain > 0 else (float(n), -1)
    used, out = set(), []
    for i in sorted(range(m), key=lambda i: -score[i]):
        path = []
        while i >= 0 and i not in used:
            used.add(i)
            path.append(parts[i])
            i = back[i]
        if path:
            out.append(path[::-1])
    return out


def pieces(chain: Runs) -> list[Runs]:
    """A chain cut at gaps of more than MOST_GAP words, its runs cut where they overlap and joined where they touch on one diagonal."""
    out: list[Runs] = [[]]
    for x, y, n in chain:
        if out[-1]:
            p, q, m = out[-1][-1]
            if x - y == p - q and x <= p + m:
                out[-1][-1] = p, q, max(m, x + n - p)
                continue
            cut = max(0, p + m - x, q + m - y)
            if cut >= n:
                continue
            x, y, n = x + cut, y + cut, n - cut
            if max(x - p - m, y - q - m) > MOST_GAP:
                out.append([])
        out[-1].append((x, y, n))
    return out


def asked(parts: Runs, side: int) -> list[int]:
    """The ranges of words (first, end, first, end, ...) that aligned() needs of a text: before the first run, between runs, behind the last."""
    out = [max(0, parts[0][side] - EDGE)]
    for p in parts:
        out += [p[side], p[side] + p[2]]
    return [*out, out[-1] + EDGE]


def common(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, bit-parallel over a."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def extended(a: list[int], b: list[int]) -> tuple[int, int]:
    """How many words of a go on with b: the most, ending with an equal word, of which IDENTITY is equal in an alignment with at most BAND
    words more on one side; with its score, of SCORE for an equal word and LOSS for another. Given up where all alignments are DROP behind."""
    out, none = (0, 0), -1 << 30
    row = [none] * (2 * BAND + 1)
    for j in range(BAND + 1):
        row[BAND + j] = -LOSS * j
    for i, w in enumerate(a):
        new, best = [], none
        for k in range(2 * BAND + 1):
            j = i + k - BAND  # the word of b that w meets
            s = max(row[k + 1] if k < 2 * BAND else none, new[-1] if new else none) - LOSS
            if 0 <= j < len(b):
                if b[j] == w:
                    s = max(s, row[k] + SCORE)
                    if s >= 0 and s == row[k] + SCORE and (i + 1 > out[0] or s > out[1]):
                        out = i + 1, s
                else:
                    s = max(s, row[k] - LOSS)
            elif j >= len(b):
                s = none
            new.append(s)
            best = max(best, s)
        row = new
        if best < -DROP:
            break
    return out


def aligned(parts: Runs, a: list[int], b: list[int], own: bool = False) -> list[tuple[int, int]]:
    """The ranges of words here that an alignment through a chain covers: its longest parts of which IDENTITY is equal and that have no gap with
    more than UNEQUAL unequal words.

    a, b: the words of asked(), here and there. A gap counts as many words as its longer side has. A part begins and ends with a run, and
    goes on into the gap before or behind it (extended()). own: the other text is this one, read before the first run only.
    """

    def cut(words: list[int], side: int) -> list[list[int]]:
        ends = asked(parts, side)
        out, at = [], 0
        for x, y in zip(ends[::2], ends[1::2], strict=True):
            out.append(words[at : at + y - x])
            at += y - x
        return out

    here, there = cut(a, 0), cut(b, 1)
    if own:
        there[-1] = there[-1][: max(0, parts[0][0] - parts[-1][1] - parts[-1][2])]
    out: list[tuple[int, int]] = []
    need, have, starts, ends = [], [], [], []
    at = 0  # SCORE for each equal word less LOSS for each other
    for i, (x, _, n) in enumerate(parts):
        left, gain = extended(here[i][::-1], there[i][::-1])
        need.append(at - gain)
        starts.append(x - left)
        at += SCORE * n
        right, gain = extended(here[i + 1], there[i + 1])
        have.append(at + gain)
        ends.append(x + n + right)
        equal, size = common(here[i + 1], there[i + 1]), max(len(here[i + 1]), len(there[i + 1]))
        at += SCORE * equal - LOSS * (size - equal)
        if i + 1 == len(parts) or size - equal > UNEQUAL:
            top = np.maximum.accumulate(np.array(have)[::-1])[::-1]
            far = -1
            for k, j in enumerate((np.searchsorted(-top, -np.array(need), "right") - 1).tolist()):  # the last run with which a part that begins here is equal enough
                if j > far:
                    out.append((starts[k], ends[j]))
                    far = j
            need, have, starts, ends = [], [], [], []
    return out


def merged(spans: list[tuple[int, int, int]], least: int, join: int) -> list[tuple[int, int, list[int]]]:
    """Of spans (start, end, document it matches): the passages (start, end, documents) of least words or more; spans at most join words apart are one."""
    out: list[list] = []
    for a, b, f in sorted(s for s in spans if s[1] - s[0] >= SHORTEST):
        if out and a <= out[-1][1] + join:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2].add(f)
        else:
            out.append([a, b, {f}])
    return [(a, b, sorted(f)) for a, b, f in out if b - a >= least]


def earlier(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of seeds in order of doc and word: the number of the same document's previous seed that is equal, or -1."""
    order = np.argsort(h, kind="stable")
    again = h[order][1:] == h[order][:-1]
    some = order[np.append(again, False) | np.append([False], again)[: len(h)]]  # few: those that are there more than once
    some = some[np.lexsort((some, h[some], doc[some]))]
    same = ~changes(doc[some], h[some])
    out = np.full(len(h), -1)
    out[some[same]] = some[np.flatnonzero(same) - 1]
    return out


def _factor() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)


def keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, text of the rows that have a text, each different pair once under a doc_id of its own; and, where these aren't those of docs, what they stand for: ent (the new doc_id),
    doc_id, row, row2 (hashes of the text). New doc_ids are in order of the old ones (rows without one come first) and of the hashes."""
    docs = docs.where("text is not null").select("doc_id", "text")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs, None
    own = ("doc_id", "row", "row2")
    texts = docs.withColumns(_told()).groupBy(*own).agg(F.first("text").alias("text"))
    ranked = docs.withColumns(_told()).select(*own).distinct().repartitionByRange(*own).sortWithinPartitions(*own)
    names = scratch.table(ranked.select(F.monotonically_increasing_id().alias("ent"), *own), "names")
    known = names.select("ent", *[F.col(c).alias(f"_{c}") for c in own])
    rows = texts.join(known, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("row") == F.col("_row")) & (F.col("row2") == F.col("_row2")))
    return scratch.table(rows.select(F.col("ent").alias("doc_id"), "text"), "texts"), names


def _told() -> dict[str, Column]:
    """What tells texts apart: 128 bits."""
    return {"row": F.xxhash64("text"), "row2": F.xxhash64(F.lit(7), "text")}


def matches(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """doc_id, first_id, at, first_at: first words of a seed here and where it occurs before: in the same document the last time
    (so that runs of one period are on one diagonal), else in the first document that has it. Seeds that come again within a document don't take part in the join."""
    factor = _factor()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            texts = texts_of(batch)
            w, start = hashes.of(b"\n".join(texts).lower())
            stop = np.cumsum([len(t) + 1 for t in texts])
            doc = np.searchsorted(stop, start, "right")
            h, at = seeds(w, doc, factor, window)
            doc_at = doc[at]
            begin = np.concatenate([[0], np.searchsorted(start, stop)])[:-1]
            place, before = at - begin[doc_at], earlier(h, doc_at)
            again = before >= 0
            h[again] = mixed(h[again] + place[again].view(np.uint64))  # these go through the join unpaired, and anywhere
            yield {"seed": h.view(np.int64), "doc_id": batch.column(0).to_numpy()[doc_at], "place": np.where(again, place[before] + 1, 0) << 32 | place}

    def pair(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows seed, doc_id, place sorted so: matches with the first row of each seed."""
        last: tuple[int, int, int] | None = None
        for batch in parts:
            seed, doc, place = (batch.column(i).to_numpy() for i in range(3))
            at, before = (place & 0xFFFFFFFF).astype(np.int32), (place >> 32).astype(np.int32) - 1
            own = before >= 0
            if own.any():
                yield {"doc_id": doc[own], "first_id": doc[own], "at": at[own], "first_at": before[own]}
                seed, doc, at = seed[~own], doc[~own], at[~own]
            if not len(seed):
                continue
            new = np.ones(len(seed), bool)
            new[1:] = seed[1:] != seed[:-1]
            if last is not None and seed[0] == last[0]:
                new[0] = False
            lead = np.maximum.accumulate(np.where(new, np.arange(len(seed)), -1))
            carried = lead < 0
            first, first_at = doc[lead], at[lead]
            if carried.any():
                first[carried], first_at[carried] = last[1], last[2]
            last = (int(seed[-1]), int(first[-1]), int(first_at[-1]))
            yield {"doc_id": doc[~new], "first_id": first[~new], "at": at[~new], "first_at": first_at[~new]}

    rows = arrow(docs, run, "seed long, doc_id long, place long", pa.schema([("seed", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())]))
    rows = spread(rows, "seed").sortWithinPartitions("seed", "doc_id", "place")
    types = pa.schema([("doc_id", pa.int64()), ("first_id", pa.int64()), ("at", pa.int32()), ("first_at", pa.int32())])
    with wide(docs.sparkSession):
        return scratch.table(arrow(rows, pair, "doc_id long, first_id long, at int, first_at int", types), "matches")


def chained(found: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """doc_id, no, first_id, runs (flat) of every piece of a chain, numbered within its document, and what aligned() needs of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in whole(batches):
            rows = anchors(*(batch.column(i).to_numpy().astype(np.int64) for i in range(4)))
            keep = dense(np.cumsum(changes(rows[0], rows[1])), rows[2], rows[4], PAIRED, 0)
            rows = [c[keep] for c in rows]
            if len(rows[0]):
                keep = dense(rows[0], rows[2], rows[4], SEEDED, least - 2 * EDGE)
                rows = [c[keep] for c in rows]
            doc, first, x, y, n = rows
            if not len(doc):
                continue
            bounds = [*np.flatnonzero(changes(doc, first)).tolist(), len(doc)]
            every = list(zip(x.tolist(), y.tolist(), n.tolist(), strict=True))
            out: dict[str, list] = {f.name: [] for f in types}
            no, of = 0, None
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                d, f = int(doc[a]), int(first[a])
                no, of = (no, d) if d == of else (0, d)
                for chain in chains(every[a:b]):
                    for p in pieces(chain):
                        for c, v in zip(out, (d, no, f, [v for r in p for v in r], asked(p, 0), asked(p, 1)), strict=True):
                            out[c].append(v)
                        no += 1
            yield out

    ints = pa.list_(pa.int32())
    types = pa.schema([("doc_id", pa.int64()), ("no", pa.int32()), ("first_id", pa.int64()), ("runs", ints), ("here", ints), ("there", ints)])
    with wide(found.sparkSession):
        rows = spread(found, "doc_id").sortWithinPartitions("doc_id")
        return scratch.table(arrow(rows, run, "doc_id long, no int, first_id long, runs array<int>, here array<int>, there array<int>", types), "chains")


def answered(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, no, side, words (their hashes) of the ranges that found asks for; a text meets what is asked of it, much asked ones in several tasks."""
    asks = found.select(F.col("doc_id").alias("of"), "doc_id", "no", F.lit(0).alias("side"), F.col("here").alias("ranges"))
    asks = asks.unionByName(found.select(F.col("first_id").alias("of"), "doc_id", "no", F.lit(1).alias("side"), F.col("there").alias("ranges")))
    hot = asks.groupBy("of").agg(F.count("*").alias("n")).where(F.col("n") > ASKED).select("of", F.ceil(F.col("n") / ASKED).cast("int").alias("salts"))
    hot = scratch.table(hot, "hot")
    salts = F.coalesce("salts", F.lit(1))
    asks = asks.join(hot, "of", "left").select("of", F.pmod(F.xxhash64("doc_id", "no"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "doc_id", "no", "side", "ranges")
    texts = docs.withColumnRenamed("doc_id", "of").join(hot, "of", "left").select("of", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "text", F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("no"), F.lit(0).alias("side"), F.lit(None).cast("array<int>").alias("ranges"))
    rows = spread(texts.unionByName(asks), "of", "salt").sortWithinPartitions("of", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        text, words = b"", None
        for batch in batches:
            kinds, texts = batch.column(2).to_pylist(), batch.column(3).cast(pa.binary())
            doc, no, side = (batch.column(i).to_pylist() for i in (4, 5, 6))
            out: dict[str, list] = {f.name: [] for f in types}
            for i, kind in enumerate(kinds):
                if not kind:
                    text, words = texts[i].as_py(), None
                    continue
                if words is None:
                    words = hashes.of(text.lower())[0]
                r = batch.column(7)[i].as_py()
                for c, v in zip(out, (doc[i], no[i], side[i], b"".join(words[a:b].tobytes() for a, b in zip(r[::2], r[1::2], strict=True))), strict=True):
                    out[c].append(v)
            yield out

    types = pa.schema([("doc_id", pa.int64()), ("no", pa.int32()), ("side", pa.int32()), ("words", pa.binary())])
    return scratch.table(arrow(rows, run, "doc_id long, no int, side int, words binary", types), "words")


def passages(docs: DataFrame, least: int = 50, join: int = 4, window: int = WINDOW) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), first_ids (documents it matches, as far as they have a doc_id) of every repeated passage.

    join: alignments of one document that lie so many words apart or less are one passage. window: of so many runs of K words in a row one is a seed; with 1 all are.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    found, names = _passages(docs, least, join, window, scratch)
    if names is None:
        return found
    found = scratch.table(found, "passages")
    firsts = found.select("doc_id", "start_word", "end_word", F.explode("first_ids").alias("ent")).join(names.select("ent", F.col("doc_id").alias("first")), "ent")
    firsts = firsts.groupBy("doc_id", "start_word", "end_word").agg(F.array_sort(F.collect_set("first")).alias("first_ids"))
    return firsts.withColumnRenamed("doc_id", "ent").join(names.select("ent", "doc_id"), "ent").select("doc_id", "start_word", "end_word", "first_ids")


def _passages(docs: DataFrame, least: int, join: int, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """As passages(), by the doc_ids of keyed(); and what these stand for."""
    docs, names = keyed(docs, scratch)
    found = chained(matches(docs, scratch, window), least, scratch)
    words = answered(docs, found, scratch)
    none = F.lit(None)
    rows = found.select("doc_id", "no", F.lit(2).alias("side"), "first_id", "runs", none.cast("binary").alias("words"))
    rows = rows.unionByName(words.select("doc_id", "no", "side", none.cast("long").alias("first_id"), none.cast("array<int>").alias("runs"), "words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in whole(batches):
            held: dict[int, dict[int, list]] = {}
            for d, no, side, f, runs, words in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                held.setdefault(d, {}).setdefault(no, [None] * 3)[side] = np.frombuffer(words, np.int64).tolist() if side < 2 else (f, runs)
            out: dict[str, list] = {c: [] for c in ("doc_id", "start_word", "end_word", "first_ids")}
            for d, parts in held.items():
                spans = []
                for a, b, (f, r) in parts.values():
                    spans += [(*s, f) for s in aligned(list(zip(r[::3], r[1::3], r[2::3], strict=True)), a, b, d == f)]
                for row in merged(spans, least, join):
                    for c, v in zip(out, (d, *row), strict=True):
                        out[c].append(v)
            yield out

    types = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("first_ids", pa.list_(pa.int64()))])
    rows = spread(rows, "doc_id").sortWithinPartitions("doc_id")
    return arrow(rows, run, "doc_id long, start_word long, end_word long, first_ids array<long>", types), names


def without_repeats(docs: DataFrame, least: int = 50, window: int = WINDOW) -> DataFrame:
    """docs with texts that lack the repeated passages: their words and the white space after each. Of rows that repeat a doc_id and a text all lose the same."""
    key, row, row2, gone = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("id", "row", "row2", "gone"))
    found, names = _passages(docs, least, 4, window, Scratch(docs.sparkSession, "substring"))
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(gone))  # as many as a document has
    same = F.col("doc_id") == F.col(key)
    if names is not None:
        found = found.join(names.withColumnRenamed("ent", key), key).select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("row2").alias(row2), gone)
        told = _told()
        same = F.col("doc_id").eqNullSafe(F.col(key)) & (told["row"] == F.col(row)) & (told["row2"] == F.col(row2))
    both = docs.join(found.hint("merge"), same, "left")
    keep = F.expr(rf"array_join(transform(filter(transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0), (w, i) -> struct(w as w, i as i)), x -> not exists({gone}, g -> x.i >= g.start_word and x.i < g.end_word)), x -> x.w), '')")
    return both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(keep)).select(*[F.col(f"`{c}`") for c in docs.columns])
