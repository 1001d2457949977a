"""Vector code compression: product quantisation by delta-maintained Lloyd rounds.

Every component x becomes the integer floor(scale * x), vectors are cut into consecutive parts of equal length, and each part position has a codebook of a few entries. A round
assigns every part to its nearest entry and replaces each entry by the floor of its parts' mean. What a round needs of the rounds before is kept: every vector's assignment, as a
table, and the integer sum and count of every entry. A round shuffles only what changes them, an addition and a subtraction for each part that moved, summed up in the task first: a row for
each entry and task at most, and fewer as assignments settle. All sums are of integers, so they don't depend on any order.

The quantised vectors are written once, bucketed by row number; the assignments of a round (a byte for each part) are written in the same buckets, so vectors and assignments meet
without a shuffle of vectors. Assignments go when newer ones are written.

Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of another length than the first one's (that of the smallest vec_id). The codebooks
start with the vectors of the smallest vec_ids; null vec_ids come last, vectors of one vec_id in the order of their packed bytes; of fewer vectors than entries each is an entry. Where parts
don't divide the length, the first ones are a component longer; empty parts have code 0. Of entries equally near the first wins; entries without parts stay. Integers beyond +-2^25 count as
that bound, so squared distances are exact in 64 bits. Repeated rows are vectors of their own. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow
from .warc import opened

#: Integers are kept within this bound.
BOUND = 1 << 25
#: Bytes of quantised vectors in a bucket, about; buckets at most, as Spark has it.
BUCKET_BYTES, MOST_BUCKETS = 96 << 20, 100_000
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def cuts(dim: int, parts: int) -> list[int]:
    """Where parts begin and end."""
    small, extra = divmod(dim, parts)
    return [k * small + min(k, extra) for k in range(parts + 1)]


def nearest(x: np.ndarray, books: list[np.ndarray], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part, and the squared distances added up. x: rows of integers; books: entries x components of each part."""
    code, far = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for p, book in enumerate(books):
        part = x[:, at[p] : at[p + 1]]
        if not part.size:
            continue
        top = max(int(np.abs(part.astype(np.int64)).max()), int(np.abs(book).max()))
        kind = np.float64 if 4 * top * top * part.shape[1] < 1 << 53 else np.int64  # nothing is rounded either way
        part, c = part.astype(kind), book.astype(kind)
        d = (part * part).sum(1)[:, None] - 2 * (part @ c.T) + (c * c).sum(1)
        code[:, p] = d.argmin(1)  # the first of the least
        far += d[rows, code[:, p]].astype(np.int64)
    return code, far


class Sums:
    """Sums and counts of the parts of each entry, or what changes them."""

    def __init__(self, entries: int, at: list[int]) -> None:
        self.at = at
        self.total, self.n = np.zeros((entries, at[-1]), np.int64), np.zeros((len(at) - 1, entries), np.int64)

    def moved(self, x: np.ndarray, new: np.ndarray, old: np.ndarray | None) -> None:
        """Adds the parts whose entry changed to their new entries and takes them from the old; old: None where none has been assigned before."""
        for p in range(new.shape[1]):
            rows = np.arange(len(x)) if old is None else np.flatnonzero(new[:, p] != old[:, p])
            part = x[rows, self.at[p] : self.at[p + 1]].astype(np.int64)
            for entry, sign in ((new, 1), *(() if old is None else ((old, -1),))):
                e = entry[rows, p].astype(np.int64)
                self.n[p] += sign * np.bincount(e, minlength=self.n.shape[1])
                for k in np.unique(e):
                    self.total[k, self.at[p] : self.at[p + 1]] += sign * part[e == k].sum(0)

    def rows(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """part, entry, change of the count, changes of the sums; only of what changes."""
        for p, k in np.ndindex(self.n.shape):
            sums = self.total[k, self.at[p] : self.at[p + 1]]
            if self.n[p, k] or sums.any():
                yield p, k, int(self.n[p, k]), sums.tolist()


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """row, vec_id, label, dim, x (little-endian integers of two bytes, or of four where two are too few) of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            col = batch.column(3)
            size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
            v = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls are NaN
            end = np.cumsum(np.maximum(size, 0))
            row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
            keep = np.flatnonzero((size >= 0) & (np.bincount(row[~np.isfinite(v)], minlength=len(size)) == 0))
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.clip(np.nan_to_num(np.floor(v * scale)), -BOUND, BOUND).astype("<i4")
            each = [q[end[i] - size[i] : end[i]] for i in keep.tolist()]
            raw = [(a if len(a) and np.abs(a).max() >= 1 << 15 else a.astype("<i2")).tobytes() for a in each]
            take = pa.array(keep)
            yield {"row": batch.column(0).take(take), "vec_id": batch.column(1).take(take), "label": batch.column(2).take(take), "dim": size[keep], "x": raw}

    types = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("x", pa.binary())])
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return arrow(rows, run, "row long, vec_id long, label string, dim int, x binary", types)


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of int32."""
    if not dim:
        return np.zeros((len(raw), 0), np.int32)
    if all(len(r) == 2 * dim for r in raw):
        return np.frombuffer(b"".join(raw), "<i2").reshape(-1, dim).astype(np.int32)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<i4") for r in raw], np.int32).reshape(-1, dim)


class _Buckets:
    """Tables in the shared folder, bucketed alike by row."""

    def __init__(self, spark: SparkSession, scratch: Scratch, size: int) -> None:
        """size: bytes of the largest."""
        self.spark, self.scratch, self.held = spark, scratch, {}
        self.n = min(MOST_BUCKETS, max(-(-size // BUCKET_BYTES), spark.sparkContext.defaultParallelism))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        own, path = f"codes_{name}_{uuid.uuid4().hex[:12]}", self.scratch.path(name)
        df.write.bucketBy(self.n, "row").option("compression", "lz4").option("path", path).saveAsTable(own)
        self.held[own] = path
        return self.spark.table(own)

    def drop(self, last: int = 0) -> None:
        """Drops all tables, or all but the first and the last so many."""
        for own in list(self.held)[1 if last else 0 : len(self.held) - last]:
            self.spark.sql(f"DROP TABLE {own}")
            where, at = opened(self.held.pop(own))
            where.delete_dir(at)


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vectors: vec_id, embedding (array of numbers), label. Returns, of the vectors that are kept, vec_id, code (two hex digits for the entry of each part), error (squared distance),
    label_error (errors of its label's vectors added up; null is a label), codebooks_sha256 (of all entries' integers by part, entry and position, joined by commas)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    flat = scratch.table(packed(vectors, scale), "flat")
    order = (F.col("vec_id").asc_nulls_last(), "dim", "x")
    one = flat.orderBy(*order).limit(1).collect()
    if not one:
        return spark.createDataFrame([], SCHEMA)
    dim = one[0].dim
    at = cuts(dim, parts)
    flat = flat.where(F.col("dim") == dim)
    book = unpacked([r.x for r in flat.orderBy(*order).limit(entries).collect()], dim).astype(np.int64)
    sums = Sums(len(book), at)
    size = flat.agg(F.sum(F.length("x") + 24)).first()[0]
    buckets = _Buckets(spark, scratch, size)
    held = buckets.table(flat.select("row", "vec_id", "label", "x").repartition(buckets.n, "row"), "vectors")
    books = lambda: [book[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    known: DataFrame | None = None
    for _ in range(rounds):
        both = held.select("row", "x")
        both = both.withColumn("code", F.lit(None).cast("binary")) if known is None else both.join(known.where("row is not null").select("row", "code").hint("shuffle_hash"), "row")
        known = buckets.table(arrow(both, _round(books(), at, dim), ROUND, ROUND_TYPES), "assigned")
        buckets.drop(last=1)
        change = known.where("row is null").select("part", "entry", "n", F.posexplode_outer("sums").alias("k", "v")).groupBy("part", "entry", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        for r in change.collect():  # as many as codebooks have components
            if r.k is not None:
                sums.total[r.entry, at[r.part] + r.k] += r.v
            if r.k in (None, 0):
                sums.n[r.part, r.entry] += r.n
        for p in range(parts):
            full = np.flatnonzero(sums.n[p])
            book[full, at[p] : at[p + 1]] = sums.total[full, at[p] : at[p + 1]] // sums.n[p, full, None]
    final = books()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            c, far = nearest(unpacked(batch.column(2).to_pylist(), dim), final, at)
            yield {"vec_id": batch.column(0), "label": batch.column(1), "code": [v.tobytes().hex() for v in c], "error": far}

    types = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
    coded = scratch.table(arrow(held.select("vec_id", "label", "x"), code, "vec_id long, label string, code string, error long", types), "coded")
    buckets.drop()
    digest = hashlib.sha256(",".join(str(v) for b in final for v in b.reshape(-1).tolist()).encode()).hexdigest()
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


ROUND = "row long, code binary, part int, entry int, n long, sums array<long>"
ROUND_TYPES = pa.schema([("row", pa.int64()), ("code", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _round(books: list[np.ndarray], at: list[int], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    """row, x, code so far -> row and its new code; and without a row what the task's vectors change in the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        change = Sums(len(books[0]), at)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, before = unpacked(batch.column(1).to_pylist(), dim), batch.column(2).to_pylist()
            old = None if before[0] is None else np.frombuffer(b"".join(before), np.uint8).reshape(n, -1)
            new, _ = nearest(x, books, at)
            change.moved(x, new, old)
            none = [None] * n
            yield {"row": batch.column(0), "code": [v.tobytes() for v in new], "part": none, "entry": none, "n": none, "sums": none}
        rows = list(change.rows())
        none = [None] * len(rows)
        yield {"row": none, "code": none, "part": [r[0] for r in rows], "entry": [r[1] for r in rows], "n": [r[2] for r in rows], "sums": [r[3] for r in rows]}

    return run
