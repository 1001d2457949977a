"""Exact Jaccard joins of texts (whole documents or single lines) as sets of word shingles.

1. One pass hashes the shingles of every item, writes a row with the hash of its set (128 bits; equal sets are one
   class from here on) and counts shingles in a sketch of fixed size, from which rarity is read.
2. A second pass orders each set by rarity and emits its prefix: as two sets with Jaccard >= t share
   SHARED elements of their first n - ceil(t n) + SHARED, only sets that share so many can link.
3. blocks.py gathers such sets into groups, holds each set's prefix against the matrix of groups and the elements that any member has there, and opens
   qualifying groups, block against block; there the length filter, the union bound and the prefix and positional filters are applied and overlaps counted exactly.
4. A group of more than LED blocks elects the set that occurs first; sets that link with it aren't compared with each other.

Words are maximal runs outside [\\x20\\x09-\\x0D] after A-Z are lower-cased; an item with fewer than k
words is one shingle; an item without words has the empty set and links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Postings, cut, grouped, led, met, opened, placed
from .common import Scratch, WordHashes, arrow, changes, mixed, spread, texts_of, wide

#: Counters of the rarity sketch: 2 ** SKETCH_BITS, whatever the size of the corpus; one byte each when sent out.
SKETCH_BITS = 22
CHUNK = 1 << 16
#: By so many elements prefixes have to meet, if the smallest sets that can link have as many.
SHARED = 3
#: Groups of more blocks than this elect a leader: what a set costs in its own group is bounded by so many blocks and the sets that don't follow one.
LED = 16
#: Shingles are made from so many words at a time.
PIECE = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Sets of words-word shingles link when 100 * intersection >= percent * union. lines: items are lines."""

    words: int = 5
    percent: int = 80
    lines: bool = False
    block: int = 128

    @property
    def smallest(self) -> int:
        """The size of the smallest set that can link with a different set (a larger one)."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 30

    @property
    def shared(self) -> int:
        """By so many elements the prefixes of sets that link have to meet."""
        return min(SHARED, self.smallest)


class Shingler:
    def __init__(self, rule: Rule) -> None:
        self.rule, self.hashes = rule, WordHashes()
        rng = np.random.default_rng(20_240_117)
        self.factor = rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

    def items(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[int], list[int], np.ndarray]:
        """Of each item: its shingles (not distinct yet); document index; number in it. Last: all shingles."""
        if not texts:
            return [], [], [], np.empty(0, np.uint64)
        k = self.rule.words
        joined = b"\n".join(texts).lower()
        w, start = self.hashes.of(joined)
        if self.rule.lines:
            count = [t.count(b"\n") + 1 for t in texts]
            doc = np.repeat(np.arange(len(texts)), count).tolist()
            no = [j for c in count for j in range(c)]
            stop = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), len(joined))
        else:
            doc, no = list(range(len(texts))), [0] * len(texts)
            stop = np.cumsum([len(t) + 1 for t in texts]) - 1
        ends = np.searchsorted(start, stop).tolist()
        s = np.zeros(len(w), np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, len(w), PIECE):
                part = s[a : a + PIECE]
                for j in range(k):
                    more = w[a + j : a + j + len(part)]
                    part[: len(more)] += more * self.factor[j]
                part[:] = mixed(part)
            ends = np.array(ends, np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            n = ends - begins
            for i in np.flatnonzero((n > 0) & (n < k)).tolist():  # one shingle of all words; it stands where the first word does
                a, b = begins[i], ends[i]
                s[a] = mixed(np.array([(w[a:b] * self.factor[k : k + b - a]).sum() + np.uint64(b - a)], np.uint64))[0]
        n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        flat = s[np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ends = np.cumsum(n)
        return [flat[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], doc, no, flat


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    if len(x) < 2:
        return x
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def distinct_each(sets: list[np.ndarray]) -> list[np.ndarray]:
    """distinct() of many arrays."""
    if not sets:
        return []
    flat = np.concatenate(sets)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(n)
    bounds = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
    for a, b in bounds:
        flat[a:b].sort()
    again = np.zeros(len(flat), bool)
    again[1:] = flat[1:] == flat[:-1]
    again[(ends - n)[n > 0]] = False
    if again.any():
        upto = np.concatenate([[0], np.cumsum(~again)])
        flat = flat[~again]
        bounds = list(zip(upto[ends - n].tolist(), upto[ends].tolist(), strict=True))
    return [flat[a:b] for a, b in bounds]


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted sets: two signed 64-bit numbers each, which together tell them apart (of empty sets: any numbers)."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    out, more = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if n.any():
        with np.errstate(over="ignore"):
            flat = np.concatenate(sets)
            full = n > 0
            starts = (np.cumsum(n) - n)[full]
            out[full] = np.add.reduceat(flat, starts)
            more[full] = np.add.reduceat((flat ^ flat >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9), starts)
            out = mixed(out + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return out.view(np.int64), more.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and row: rows of one doc_id with different texts are different rows, all others that repeat are one."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("row"))


#: Where no document has an id: above all that there are.
NONE = np.iinfo(np.int64).max


def first_of_each(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of rows sig, sig2, known (whether there is a doc_id), doc_id, row, item, n, low, one for each sig, sig2, in their order: the first by doc_id (none
    comes first), row and item, with the sum of n and the least of low. Second: where each stood."""
    order = np.lexsort((c["item"], c["row"], c["doc_id"], c["known"], c["sig2"], c["sig"]))
    start = np.flatnonzero(changes(c["sig"][order], c["sig2"][order]))
    at = order[start]
    out = {k: v[at] for k, v in c.items()}
    if len(at):
        out["n"], out["low"] = np.add.reduceat(c["n"][order], start), np.minimum.reduceat(c["low"][order], start)
    return out, at


def classes(items: DataFrame, scratch: Scratch) -> DataFrame:
    """sig, sig2, doc_id, row, item (where each set first occurs), copies (how often it does), low (the smallest doc_id that has it).

    survey() has taken together what a batch has of a set, so a very common one is a row a batch here; of these only the first so far is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(2)
            cols = {"sig": batch.column(0).to_numpy(), "sig2": batch.column(1).to_numpy(), "known": doc.is_valid().to_numpy(zero_copy_only=False), "doc_id": doc.fill_null(0).to_numpy(), "row": batch.column(3).to_numpy(), "item": batch.column(4).to_numpy(), "n": batch.column(5).to_numpy(), "low": batch.column(6).to_numpy()}
            if held is not None:
                cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
            cols, _ = first_of_each(cols)
            cut = int(np.searchsorted(cols["sig"], cols["sig"][-1]))  # rows of the last one may go on
            held = {k: v[cut:] for k, v in cols.items()}
            yield done({k: v[:cut] for k, v in cols.items()})
        if held is not None:
            yield done(held)

    def done(c: dict[str, np.ndarray]) -> dict:
        return {"sig": c["sig"], "sig2": c["sig2"], "doc_id": pa.array(c["doc_id"], pa.int64(), mask=~c["known"]), "row": c["row"], "item": c["item"], "copies": c["n"], "low": pa.array(c["low"], pa.int64(), mask=c["low"] == NONE)}

    long, int_ = pa.int64(), pa.int32()
    types = pa.schema([("sig", long), ("sig2", long), ("doc_id", long), ("row", long), ("item", int_), ("copies", long), ("low", long)])
    with wide(items.sparkSession):
        rows = spread(items.where("lead > 0").select("sig", "sig2", "doc_id", "row", "item", "lead", "low"), "sig").sortWithinPartitions("sig")
        return scratch.table(arrow(rows, run, "sig long, sig2 long, doc_id long, row long, item int, copies long, low long", types), "classes")


def survey(docs: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """Rows doc_id, row, item, n, sig, sig2 (null for empty sets) of all items, with lead (of the first item in a batch that has a set: how many have it there;
    else 0) and low (the smallest doc_id there that has it); the classes of rarity by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sh, size = Shingler(rule), 1 << SKETCH_BITS
        counts, held, n_held = np.zeros(size, np.int64), [], 0
        for batch in batches:
            sets, doc, no, flat = sh.items(texts_of(batch))
            held.append((flat & np.uint64(size - 1)).astype(np.int32))
            n_held += len(flat)
            if n_held > 4_000_000:
                counts += np.bincount(np.concatenate(held), minlength=size)
                held, n_held = [], 0
            sets = distinct_each(sets)
            at, none = pa.array(doc, pa.int64()), np.array([not len(x) for x in sets], bool)
            sig, sig2 = set_hashes(sets)
            ids, row, no = batch.column(0).take(at), batch.column(2).take(at), np.array(no, np.int32)
            full = np.flatnonzero(~none)
            known, doc = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            every = {"sig": sig, "sig2": sig2, "known": known, "doc_id": doc, "row": row.to_numpy(), "item": no, "n": np.ones(len(sets), np.int64), "low": np.where(known, doc, NONE)}
            first, where = first_of_each({k: v[full] for k, v in every.items()})
            lead, low = np.zeros(len(sets), np.int64), np.full(len(sets), NONE)
            lead[full[where]], low[full[where]] = first["n"], first["low"]
            yield {"doc_id": ids, "row": row, "item": no, "n": [len(x) for x in sets], "sig": pa.array(sig, pa.int64(), mask=none), "sig2": pa.array(sig2, pa.int64(), mask=none), "lead": lead, "low": low, "counts": [None] * len(sets)}
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size)
        for c in range(0, size, CHUNK):
            part = counts[c : c + CHUNK]
            if at := np.flatnonzero(part).astype(np.uint16).tobytes():
                yield {"doc_id": [None], "row": [None], "item": [-1 - c // CHUNK], "n": [0], "sig": [None], "sig2": [None], "lead": [0], "low": [0], "counts": [at + part[part > 0].tobytes()]}

    types = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("item", pa.int32()), ("n", pa.int32()), ("sig", pa.int64()), ("sig2", pa.int64()), ("lead", pa.int64()), ("low", pa.int64()), ("counts", pa.binary())])
    rows = scratch.table(arrow(keyed(docs), run, "doc_id long, row long, item int, n int, sig long, sig2 long, lead long, low long, counts binary", types), "items")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(raw) // 10
                sums.setdefault(c, np.zeros(CHUNK, np.int64))[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, np.int64, n, 2 * n)
        for c, x in sums.items():
            yield {"item": [c], "counts": [np.minimum(np.log2(x + 1.0) * 4, 127).astype(np.uint8).tobytes()]}

    parts = spread(rows.where("item < 0").select("item", "counts"), "item")
    table = np.zeros(1 << SKETCH_BITS, np.uint8)
    for c, raw in arrow(parts, add, "item int, counts binary", pa.schema([("item", pa.int32()), ("counts", pa.binary())])).collect():  # 2 ** SKETCH_BITS bytes
        table[(-1 - c) * CHUNK : -c * CHUNK] = np.frombuffer(raw, np.uint8)
    return rows.where("item >= 0").drop("counts"), table


def ordered(sets: list[np.ndarray], rarity: np.ndarray) -> list[np.ndarray]:
    """The elements of each set in the one order that all sets share: rare ones first."""
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    cls = rarity[(x & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64)
    x, out, a = (cls << np.uint64(56)) | (x >> np.uint64(8)), [], 0
    for n in map(len, sets):
        part = x[a : a + n]
        part.sort()
        out.append(part)
        a += n
    return out


def ceil_share(n: int, rule: Rule) -> int:
    return -(-n * rule.percent // 100)


def candidates(docs: DataFrame, rule: Rule, rarity: np.ndarray, total: int) -> DataFrame:
    """Postings (about total) token, ent (a set's hash) of the prefixes; a task emits the same set once. Sets too small to link with a different one are left out."""
    sent, postings = docs.sparkSession.sparkContext.broadcast(rarity), Postings(total)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sh, seen, order = Shingler(rule), set(), sent.value
        for batch in batches:
            sets = distinct_each([x for x in sh.items(texts_of(batch))[0] if len(x) >= rule.smallest])
            new = []
            for i, sig in enumerate(set_hashes(sets)[0].tolist()):
                if sig not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sig)
                    new.append((i, sig))
            new = [(i, sig) for i, sig in new if len(sets[i]) >= rule.smallest]
            if new:
                every = np.concatenate(ordered([sets[i] for i, _ in new], order))
                n = np.array([len(sets[i]) for i, _ in new])
                prefix = np.minimum(n - -(-n * rule.percent // 100) + rule.shared, n)
                place = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
                yield every[place < np.repeat(prefix, n)].view(np.int64), np.repeat(np.array([sig for _, sig in new], np.int64), prefix)

    return arrow(docs.select("text"), lambda batches: postings.dealt(parts(batches)), Postings.SCHEMA, Postings.TYPES)


#: Elements of either side that linked() counts with at once.
HELD = 1 << 19
#: Bytes of sets that a task hands on at once.
HANDED = 8 << 20


def payloads(docs: DataFrame, firsts: DataFrame, places: DataFrame, rule: Rule, rarity: np.ndarray) -> DataFrame:
    """places (see placed()) with sig2, doc_id, row, item, toks: sets made anew from the first text that has each, straight to where they are needed."""
    at = firsts.select("sig", "doc_id", "row", "item").join(places.withColumnRenamed("ent", "sig"), "sig").groupBy("doc_id", "row").agg(F.collect_list(F.struct("item", "sig", "key", "blk", "part", "query")).alias("want")).hint("shuffle_hash")
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sh, order = Shingler(rule), sent.value
        out: dict[str, list] = {f.name: [] for f in types}
        size = 0
        for batch in batches:
            ids, rows, wants = (batch.column(i).to_pylist() for i in (0, 2, 3))
            sets, doc, no, _ = sh.items(texts_of(batch))
            want: list[dict] = [{} for _ in wants]
            for w, places_ in zip(want, wants, strict=True):
                for x in places_:
                    w.setdefault((x["item"], x["sig"]), []).append((x["key"], x["blk"], x["part"], x["query"]))
            sets = distinct_each(sets)
            found = [(x, i, j, *sig) for x, i, j, *sig in zip(sets, doc, no, *(h.tolist() for h in set_hashes(sets)), strict=True) if len(x) and (j, sig[0]) in want[i]]
            for (_, i, j, sig, sig2), x in zip(found, ordered([f[0] for f in found], order), strict=True):
                if raw := x.tobytes():
                    for place in want[i][j, sig]:
                        for k, v in zip(out, (*place, sig, sig2, ids[i], rows[i], j, raw), strict=True):
                            out[k].append(v)
                        size += len(raw)
                        if size > HANDED:
                            yield out
                            out, size = {f.name: [] for f in types}, 0
        yield out

    texts = keyed(docs)
    rows = texts.join(at, texts["doc_id"].eqNullSafe(at["doc_id"]) & (texts["row"] == at["row"])).select(texts["doc_id"], "text", texts["row"], "want")
    long, int_ = pa.int64(), pa.int32()
    types = pa.schema([("key", long), ("blk", int_), ("part", int_), ("query", int_), ("ent", long), ("sig2", long), ("doc_id", long), ("row", long), ("item", int_), ("toks", pa.binary())])
    return arrow(rows, run, "key long, blk int, part int, query int, ent long, sig2 long, doc_id long, row long, item int, toks binary", types)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each set of b (sorted, distinct arrays)."""
    out = np.zeros((len(a), len(b)), np.int32)
    if len(a) * len(b) <= 4:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                out[i, j] = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
        return out
    ca, cb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    va, sa, na = np.unique(ca, return_index=True, return_counts=True)
    vb, sb, nb = np.unique(cb, return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    sa, na, sb, nb = sa[ia], na[ia], sb[ib], nb[ib]
    few = na * nb <= 64
    if few.any():  # elements of few sets: their pairs one by one
        pairs = (na * nb)[few]
        el = np.repeat(np.flatnonzero(few), pairs)
        k = np.arange(len(el)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = ra[sa[el] + k // nb[el]], rb[sb[el] + k % nb[el]]
        out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape).astype(np.int32)
    many = np.flatnonzero(~few)
    for c in range(0, len(many), 2048):  # elements of many sets: a product of 0/1 matrices
        el = many[c : c + 2048]

        def matrix(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
            m = np.zeros((n, len(sizes)), np.float32)
            at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            m[rows[at], np.repeat(np.arange(len(sizes)), sizes)] = 1
            return m

        out += (matrix(ra, sa[el], na[el], len(a)) @ matrix(rb, sb[el], nb[el], len(b)).T).astype(np.int32)
    return out


def few_linked(a: list[np.ndarray], b: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """linked() for a few sets: the length filter, the positional filter (what is left behind the first element that
    two prefixes share bounds the overlap), then the overlap itself."""
    t = rule.percent
    sets, found = [set(y.tolist()) for y in b], []
    place = [{e: q for q, e in enumerate(y[: len(y) - ceil_share(len(y), rule) + 1].tolist())} for y in b]
    for i, x in enumerate(a):
        n, every = len(x), x.tolist()
        prefix, own = every[: n - ceil_share(n, rule) + 1], None
        for j, y in enumerate(sets):
            m = len(y)
            if 100 * min(n, m) < t * max(n, m):
                continue
            at = place[j]
            hit = next((p for p, e in enumerate(prefix) if e in at), None)
            if hit is None or (100 + t) * min(n - hit, m - at[prefix[hit]]) < t * (n + m):
                continue
            own = own or set(every)
            k = len(own & y)
            if 100 * k >= t * (n + m - k):
                found.append((i, j))
    out = np.array(found, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def bounds(a: list[np.ndarray], b: list[np.ndarray], rule: Rule) -> np.ndarray:
    """The positional filter for whole blocks: of each set of a and each of b, how much is left from the first element that their prefixes share on
    (in the set of which less is left); 0 where they share none."""

    def prefixes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(x) - ceil_share(len(x), rule) + 1 for x in sets]
        el = np.concatenate([x[:k] for x, k in zip(sets, n, strict=True)])
        which = np.repeat(np.arange(len(sets)), n)
        left = np.repeat([len(x) for x in sets], n) - (np.arange(len(el)) - np.repeat(np.cumsum(n) - n, n))
        order = np.argsort(el, kind="stable")
        return el[order], which[order], left[order]

    ea, ia, la = prefixes(a)
    eb, ib, lb = prefixes(b)
    out = np.zeros((len(a), len(b)), np.int64)
    both = np.intersect1d(ea, eb)[::-1]  # the first shared element is written last
    ranges = zip(*(np.searchsorted(e, both, side).tolist() for e in (ea, eb) for side in ("left", "right")), strict=True)
    for a0, a1, b0, b1 in ranges:
        if a1 - a0 == 1 == b1 - b0:
            out[ia[a0], ib[b0]] = min(la[a0], lb[b0])
        else:
            out[ia[a0:a1, None], ib[b0:b1]] = np.minimum(la[a0:a1, None], lb[b0:b1])
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that link: after the length filter the union bound, after it the prefix and positional filters, then overlaps are counted."""
    none = np.empty(0, np.int64)
    if not a or not b:
        return none, none
    if len(a) * len(b) <= 36:  # the same one by one
        return few_linked(a, b, rule)
    longer = max(a, b, key=lambda x: sum(map(len, x)))
    if len(longer) > 1 and sum(map(len, longer)) > HELD:  # sets of long texts: half of the larger side at a time
        half, parts = len(longer) // 2, []
        for lo, hi in ((0, half), (half, len(longer))):
            i, j = linked(a[lo:hi], b, rule) if longer is a else linked(a, b[lo:hi], rule)
            parts.append((i + lo, j) if longer is a else (i, j + lo))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fit = 100 * np.minimum(na[:, None], nb) >= rule.percent * np.maximum(na[:, None], nb)
    rows, cols = np.flatnonzero(fit.any(1)), np.flatnonzero(fit.any(0))
    if len(rows) and len(cols) > 1:  # a query has to find its share of elements in the union of the block
        union = distinct(np.concatenate([b[j] for j in cols]))
        rows = np.array([i for i in rows if 100 * np.isin(a[i], union, assume_unique=True, kind="sort").sum() >= rule.percent * na[i]], np.int64)
    if not len(rows) or not len(cols):
        return none, none
    sums = na[rows][:, None] + nb[cols]
    fit = fit[np.ix_(rows, cols)] & ((100 + rule.percent) * bounds([a[i] for i in rows], [b[j] for j in cols], rule) >= rule.percent * sums)
    i, j = np.flatnonzero(fit.any(1)), np.flatnonzero(fit.any(0))
    if not len(i):
        return none, none
    rows, cols, fit, sums = rows[i], cols[j], fit[np.ix_(i, j)], sums[np.ix_(i, j)]
    inter = overlaps([a[i] for i in rows], [b[j] for j in cols])
    i, j = np.nonzero((100 * inter >= rule.percent * (sums - inter)) & fit)
    return rows[i], cols[j]


def block_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """query, token arrays and the index of each distinct (query, ent, sig2) of a block's rows."""
    query, ent, more = (batch.column(i).to_numpy() for i in (3, 4, 5))
    keep = np.ones(len(ent), bool)
    keep[1:] = (ent[1:] != ent[:-1]) | (query[1:] != query[:-1]) | (more[1:] != more[:-1])
    keep = np.flatnonzero(keep)
    toks = batch.column(batch.schema.get_field_index("toks"))
    return query[keep], [np.frombuffer(toks[int(i)].as_buffer(), np.uint64) for i in keep], keep


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Of the edges i - j over n nodes, the numbers of those that join different trees."""
    up, out = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(e)
    return out


def block_links(batch: pa.RecordBatch, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (in batch) of linked pairs, each pair once; the kept rows."""
    query, toks, keep = block_sets(batch)
    m = int((query == 0).sum())
    out_i, out_j = [], []
    if m < len(toks):
        i, j = linked(toks[m:], toks[:m], rule)
        out_i.append(i + m)
        out_j.append(j)
    if batch.column(2)[0].as_py() == 0 and m > 1:
        i, j = linked(toks[:m], toks[:m], rule)
        out_i.append(i[i > j])
        out_j.append(j[i > j])
    none = np.empty(0, np.int64)
    return np.concatenate(out_i) if out_i else none, np.concatenate(out_j) if out_j else none, keep


@dataclass
class Join:
    """items (survey()), firsts (classes()), the sets where they are to be compared, and followers
    (leader, leader2, ent, sig2): sets that link with the first set of their group."""

    items: DataFrame
    firsts: DataFrame
    sets: DataFrame
    followers: DataFrame


def joined_sets(docs: DataFrame, rule: Rule, scratch: Scratch) -> Join:
    """Groups of more than LED blocks first have their sets compared with the one that occurs first; those that link with it are its
    followers, which are not compared with each other."""
    items, rarity = survey(docs, rule, scratch)
    firsts = classes(items, scratch)
    prefix = F.col("n") - F.ceil(F.col("n") * rule.percent / 100) + rule.shared
    total = items.where(F.col("n") >= rule.smallest).agg(F.sum(prefix)).first()[0] or 0
    members, asks = grouped(met(candidates(docs, rule, rarity, int(total)), scratch), scratch, rule.shared)
    groups = scratch.table(cut(members, rule.block), "blocks")
    large = groups.where(F.col("blocks") > LED).select("key", F.col("ent").alias("sig"))
    leaders = large.join(firsts, "sig").groupBy("key").agg(F.min(F.struct("doc_id", "row", "item", "sig")).alias("f")).select("key", F.col("f.sig").alias("ent"))
    leaders = scratch.table(leaders, "leaders")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts:
            query, toks, keep = block_sets(batch)
            m = int((query == 0).sum())
            i, _ = linked(toks[m:], toks[:m], rule) if m == 1 else (np.empty(0, np.int64), None)
            if len(i):
                ent, more = batch.column(4).to_numpy()[keep], batch.column(5).to_numpy()[keep]
                yield {"leader": ent[:1].repeat(len(i)), "leader2": more[:1].repeat(len(i)), "ent": ent[i + m], "sig2": more[i + m]}

    sides = "leader long, leader2 long, ent long, sig2 long"
    if leaders.isEmpty():
        followers = docs.sparkSession.createDataFrame([], sides)
    else:
        beside = payloads(docs, firsts, scratch.table(led(groups.where(F.col("blocks") > LED), leaders), "led"), rule, rarity)
        followers = scratch.table(opened(beside, run, sides, pa.schema([(c.split()[0], pa.int64()) for c in sides.split(", ")])), "followers")
        groups = scratch.table(cut(members, rule.block, followers), "blocks")
    return Join(items, firsts, payloads(docs, firsts, placed(asks, groups, scratch, rule.block), rule, rarity), followers)


def similar_edges(join: Join, rule: Rule, scratch: Scratch) -> DataFrame:
    """u, v: links between different sets, of each pair of blocks a spanning forest, and of followers that with their leader."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts:
            i, j, keep = block_links(batch, rule)
            if len(i):
                ent = batch.column(4).to_numpy()[keep]
                e = spanning(i, j, len(ent))
                yield {"u": ent[i[e]], "v": ent[j[e]]}

    links = opened(join.sets, run, "u long, v long", pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    return scratch.table(links.unionByName(join.followers.select(F.col("leader").alias("u"), F.col("ent").alias("v"))), "links")


def later_sets(join: Join, rule: Rule, scratch: Scratch) -> DataFrame:
    """sig, sig2: sets that link with a set which first occurs earlier, by (doc_id, row, item)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts:
            i, j, keep = block_links(batch, rule)
            if len(i):
                at = [(-1 << 63 if d is None else d, r, n) for d, r, n in zip(*(batch.column(c).to_pylist() for c in (6, 7, 8)), strict=True)]
                late = sorted({int(a if at[keep[a]] > at[keep[b]] else b) for a, b in zip(i, j, strict=True)})
                yield {"sig": batch.column(4).to_numpy()[keep][late], "sig2": batch.column(5).to_numpy()[keep][late]}

    late = opened(join.sets, run, "sig long, sig2 long", pa.schema([("sig", pa.int64()), ("sig2", pa.int64())]))
    return scratch.table(late.unionByName(join.followers.select(F.col("ent").alias("sig"), "sig2")).distinct(), "later")
