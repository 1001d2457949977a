"""Embedding near-duplicates by iterative quantisation.

A rotation is learnt (on a bounded sample) that turns principal components into balanced binary codes with
little quantisation error. Every vector is indexed: its code is cut into pieces, and it meets vectors of the same label
of which a piece differs in two bits at most (multi-index Hamming tables). What meets is gathered into blocks (see blocks.py)
and reranked by the cosine of the original vectors in double precision.

Equal vectors of one label are one class, so copies aren't compared with each other. Vectors that are null, empty,
zero or hold null or non-finite components, and rows without a label, link with nothing. Vectors of different
lengths link with nothing, whatever their length. A repeated vec_id is a row of its own; null vec_ids are carried along and never name a component that has another.
A cosine that equals the threshold links, so ties need no rule. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Postings, cut, grouped, met, opened, placed
from .common import Scratch, arrow, mixed
from .components import components as connected
from .setjoin import spanning

#: The rotation is fitted on so many vectors at most; all are indexed.
SAMPLE = 4096
#: Share of the pairs at the threshold that may meet in no piece, if a code's bits differ as directions at random would.
MISSED = 0.0001


def shape(n: int, least: float) -> tuple[int, int]:
    """Bits of a piece and number of pieces for n vectors of a label: pieces grow with the logarithm of n, so that few vectors meet by chance,
    and there are so many that pairs with a cosine of least have one that differs in two bits at most (each side is entered with every bit changed)."""
    width = min(60, max(16, math.ceil(math.log2(max(n, 2))) + 10))
    flip = math.acos(min(1.0, least)) / math.pi
    near = sum(math.comb(width, k) * flip**k * (1 - flip) ** (width - k) for k in range(3))
    return width, max(2, math.ceil(math.log(MISSED) / math.log(max(1e-9, 1 - near))))


class Codes:
    """Binary codes of vectors of one length."""

    def __init__(self, x: np.ndarray, dim: int, width: int, n: int, rounds: int = 40, seed: int = 7) -> None:
        """x: sample of unit vectors (may be empty: then the rotation is random). width, n: shape()."""
        rng = np.random.default_rng(seed)
        self.width, self.n, every = width, n, width * n
        self.mean = x.mean(0) if len(x) else np.zeros(dim)
        bits = min(every, dim)
        if len(x) > bits:
            c = x - self.mean
            _, axes = np.linalg.eigh(c.T @ c)
            basis = axes[:, ::-1][:, :bits]
            v = c @ basis
            r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
            for _ in range(rounds):  # codes for the rotation, then the rotation for the codes
                b = np.where(v @ r >= 0, 1.0, -1.0)
                u, _, w = np.linalg.svd(b.T @ v)
                r = (u @ w).T
            self.project = basis @ r
        else:
            self.project = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :bits]
        if bits < every:  # short vectors get random directions besides
            more = rng.standard_normal((dim, every - bits))
            self.project = np.column_stack([self.project, more])[:, rng.permutation(every)]

    def pieces(self, x: np.ndarray) -> np.ndarray:
        """Of each vector its code in n unsigned integers."""
        b = ((x - self.mean) @ self.project >= 0).astype(np.uint64)
        return (b.reshape(len(x), self.n, self.width) << np.arange(self.width, dtype=np.uint64)).sum(2).astype(np.uint64)


def usable(values: list | None) -> np.ndarray | None:
    """The vector scaled to length 1, or None."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def classes(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id, ent (hash of label and vector; null where nothing can link), label, unit (bytes of the unit vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            labels = batch.column(2).to_pylist()
            units = [usable(v) if lab is not None else None for v, lab in zip(batch.column(1).to_pylist(), labels, strict=True)]
            raw = [None if u is None else u.tobytes() for u in units]
            ents = [None if r is None else int(np.uint64(xxhash.xxh3_64_intdigest(r + str(lab).encode())).view(np.int64)) for r, lab in zip(raw, labels, strict=True)]
            yield {"vec_id": batch.column(0), "ent": ents, "label": labels, "unit": raw}

    types = pa.schema([("vec_id", pa.int64()), ("ent", pa.int64()), ("label", pa.int64()), ("unit", pa.binary())])
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return scratch.table(arrow(rows, run, "vec_id long, ent long, label long, unit binary", types), "vectors")


def near(vectors: DataFrame, least: float = 0.98, block: int = 1024) -> DataFrame:
    """vectors: vec_id, embedding (array of numbers), label. Returns vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    rows = classes(vectors, scratch)
    distinct = scratch.table(rows.where("ent is not null").groupBy("ent").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("size"), F.min("vec_id").alias("least")), "classes")
    sample: dict[int, list[np.ndarray]] = {}
    for r in distinct.select("unit").orderBy(F.xxhash64("ent"), "ent").limit(SAMPLE).toLocalIterator():
        sample.setdefault(len(r.unit) // 8, []).append(np.frombuffer(r.unit, np.float64))
    width, pieces = shape(distinct.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, least)
    sent = spark.sparkContext.broadcast({d: Codes(np.array(x), d, width, pieces) for d, x in sample.items()})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = dict(sent.value)
        flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)]).astype(np.uint64)
        for batch in batches:
            ent, label = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            units = [np.frombuffer(x, np.float64) for x in batch.column(2).to_pylist()]
            dims = np.array([len(x) for x in units])
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in codes:
                    codes[d] = Codes(np.zeros((0, d)), d, width, pieces)
                p = codes[d].pieces(np.array([units[i] for i in at]))
                where = mixed(label[at].view(np.uint64) + np.uint64(d << 40))
                token = mixed(p[:, :, None] ^ flips)
                token = mixed(token + where[:, None, None] + (np.arange(pieces, dtype=np.uint64) << np.uint64(20))[None, :, None])
                n = pieces * (width + 1)
                yield token.reshape(-1).view(np.int64), np.repeat(ent[at], n)

    postings = Postings(distinct.count() * pieces * (width + 1))
    posts = arrow(distinct.select("ent", "label", "unit"), lambda batches: postings.dealt(index(batches)), Postings.SCHEMA, Postings.TYPES)
    members, asks = grouped(met(posts, scratch), scratch)
    groups = scratch.table(cut(members, block), "blocks")

    def rerank(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts:
            query, ent = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            raw, size, label = batch.column(5).to_pylist(), batch.column(6).to_numpy(), batch.column(7).to_numpy()
            inside = batch.column(2)[0].as_py() == 0
            dims = np.array([len(x) for x in raw])
            out_i, out_j = [], []
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.array([np.frombuffer(raw[i], np.float64) for i in at])
                m = int((query[at] == 0).sum())
                ok = (x @ x[:m].T >= least) & (label[at][:, None] == label[at][:m])
                i, j = np.nonzero(ok)
                take = (i >= m) | (inside & (i > j))
                out_i.append(at[i[take]])
                out_j.append(at[j[take]])
            i, j = np.concatenate(out_i), np.concatenate(out_j)
            if not len(i):
                continue
            n = np.bincount(i, size[j], len(ent)) + np.bincount(j, size[i], len(ent))
            e = spanning(i, j, len(ent))
            k = np.flatnonzero(n)
            yield {"u": np.concatenate([ent[i[e]], ent[k]]), "v": pa.array([*ent[j[e]].tolist(), *[None] * len(k)], pa.int64()), "n": np.concatenate([np.zeros(len(e), np.int64), n[k].astype(np.int64)])}

    rows_at = placed(asks, groups, scratch, block).join(distinct.select("ent", "unit", "size", "label"), "ent")
    types = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])
    found = scratch.table(opened(rows_at, rerank, "u long, v long, n long", types), "found")
    links = found.where("v is null").groupBy(F.col("u").alias("ent")).agg(F.sum("n").alias("others"))
    roots = connected(found.where("v is not null").select("u", "v"), scratch).withColumnRenamed("node", "ent")
    known = distinct.select("ent", "size", "least").join(links, "ent", "left").join(roots, "ent", "left").withColumn("root", F.coalesce("root", "ent"))
    known = scratch.table(known, "known")
    tops = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(tops, "root").select("ent", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id")
    out = rows.select("vec_id", "ent").join(named, "ent", "left")
    top = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), F.coalesce(F.col("vec_id") == top, F.lit(True)).alias("kept"))
