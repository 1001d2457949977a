"""Groups of items that share index keys, opened block against block.

Items that share a key (a prefix token, a piece of a binary code) are gathered into groups, each
group into blocks of bounded size, and an item is sent only to the blocks of groups with which it
shares a key. What happens inside two blocks is up to the caller. No pair of items is ever a row, and
no task holds more than two blocks, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, changes, mixed, sections, spread


#: Postings that a bucket holds, at least and at most, about (between them there are BUCKETS buckets); that a task collects before it deals them out.
BUCKET, BUCKETS, COLLECTED = (1 << 19, 1 << 22), 4096, 1 << 21
#: Of what a task has collected: a token with so many items isn't dealt to one bucket.
COMMON = 1 << 16


class Postings:
    """Deals postings (token, item) to buckets by token, as arrays in binary columns: a row is a bucket's share of what a task has collected.

    An item counts as sharing a token that very many items of one task have; such postings go to any bucket, with one of these items as their first.
    """

    SCHEMA = "bucket int, posts binary, first long"
    TYPES = pa.schema([("bucket", pa.int32()), ("posts", pa.binary()), ("first", pa.int64())])

    def __init__(self, total: int) -> None:
        """total: postings in all, about."""
        self.buckets = max(1, -(-total // min(max(total // BUCKETS, BUCKET[0]), BUCKET[1])))

    def dealt(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for part in parts:
            held.append(part)
            n += len(part[0])
            if n >= COLLECTED:
                yield self._rows(held)
                held, n = [], 0
        if n:
            yield self._rows(held)

    def _rows(self, held: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        token, ent = (np.concatenate([p[i] for p in held]).astype(np.int64) for i in (0, 1))
        bucket = ((mixed(token.view(np.uint64)) >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        token, ent, bucket = token[order], ent[order], bucket[order]
        out: dict[str, list] = {"bucket": [], "posts": [], "first": []}

        def add(b: int, t: np.ndarray, e: np.ndarray, first: int | None) -> None:
            for k, v in zip(out, (b, np.concatenate([t, e]).tobytes(), first), strict=True):
                out[k].append(v)

        starts = np.flatnonzero(changes(bucket))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist(), strict=True):
            t, e = token[a:b], ent[a:b]
            if b - a >= COMMON:
                values, count = np.unique(t, return_counts=True)
                for v in values[count >= COMMON]:
                    every = np.unique(e[t == v])
                    for c in range(0, len(every), COMMON):
                        some = every[c : c + COMMON]
                        add(int(every[0] + c) % self.buckets, np.full(len(some), v), some, int(every[0]))
                common = values[count >= COMMON]
                rest = ~np.isin(t, common)
                # typed, as an empty list would make floats of 64-bit numbers
                least = np.array([e[t == v].min() for v in common], np.int64)
                t, e = np.append(t[rest], common), np.append(e[rest], least)
            add(int(bucket[a]), t, e, None)
        return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Postings, sorted by bucket: those of tokens with two items or more, each with its token's first item."""

    def several(t: np.ndarray) -> np.ndarray:
        """Which rows share their token with another row; t: sorted."""
        same = t[1:] == t[:-1]
        return np.concatenate([[False], same]) | np.concatenate([same, [False]])

    for section in sections(batches, 1):
        tokens, ents = [], []
        for raw, first in zip(section.column(1), section.column(2).to_pylist(), strict=True):
            x = np.frombuffer(raw.as_buffer(), np.int64)
            t, e = x[: len(x) // 2], x[len(x) // 2 :]
            if first is None:
                tokens.append(t)
                ents.append(e)
            else:
                yield {"token": t, "ent": e, "first": np.full(len(t), first)}
        if not tokens:
            continue
        t, e = np.concatenate(tokens), np.concatenate(ents)
        order = np.argsort(t)
        t, e = t[order], e[order]
        keep = several(t)
        t, e = t[keep], e[keep]
        order = np.lexsort((e, t))
        t, e = t[order], e[order]
        new = changes(t, e)
        t, e = t[new], e[new]
        keep = several(t) if len(t) else new
        t, e = t[keep], e[keep]
        if len(t):
            starts = np.flatnonzero(changes(t))
            yield {"token": t, "ent": e, "first": np.repeat(e[starts], np.diff(np.append(starts, len(t))))}


def met(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """postings: rows of Postings. Of tokens that two items or more have: token, ent, first (an item that has the token). An item with a common token may come twice."""
    types = pa.schema([("token", pa.int64()), ("ent", pa.int64()), ("first", pa.int64())])
    rows = spread(postings, "bucket").sortWithinPartitions("bucket")
    return scratch.table(arrow(rows, _met, "token long, ent long, first long", types), "met")


def grouped(shared: DataFrame, scratch: Scratch, need: int = 1) -> tuple[DataFrame, DataFrame]:
    """shared: met(). need: so many tokens an item shares with any item that it may link with.

    The matrix of tokens and groups (token, key, m: how many of the group have it) is a table; a query's tokens that a group has, whichever of its
    members have them, bound what it shares with any one. Returns groups (ent, key: the group of each item) and asks (ent, key: the groups
    whose bound reaches need), only of items that may link with any.
    """
    keys = scratch.table(shared.groupBy("ent").agg(F.min("first").alias("own_key")), "keys")
    at = scratch.table(shared.select("token", "ent").join(keys, "ent"), "at")
    matrix = scratch.table(at.groupBy("token", F.col("own_key").alias("key")).agg(F.count("*").alias("m")), "matrix")
    both = at.join(matrix, "token").where("key <> own_key or m > 1")
    asks = both.groupBy("ent", "own_key", "key").agg(F.count("*").alias("c")).where(F.col("c") >= need)
    asks = scratch.table(asks.select("ent", "own_key", "key"), "asks")
    groups = scratch.table(asks.select("ent", F.col("own_key").alias("key")).distinct(), "groups")
    return groups, asks.where("key <= own_key").select("ent", "key")


def cut(groups: DataFrame, block: int, followers: DataFrame | None = None) -> DataFrame:
    """ent, key, blk, blocks, loose: groups cut into blocks of about `block` items. followers (ent): items that needn't be compared with each other
    if they are of one group; they get blocks of their own, from number `loose` on."""
    if followers is None:
        groups = groups.withColumn("f", F.lit(0))
    else:
        groups = groups.join(followers.select("ent", F.lit(1).alias("g")).distinct(), "ent", "left").select("ent", "key", F.coalesce("g", F.lit(0)).alias("f"))
    count = lambda c: F.ceil(F.sum(c) / F.lit(block)).cast("int")
    sizes = groups.groupBy("key").agg(count(1 - F.col("f")).alias("loose"), count(F.col("f")).alias("rest"))
    hashed = F.xxhash64("ent")
    blk = F.when(F.col("f") == 0, F.pmod(hashed, F.greatest("loose", F.lit(1)))).otherwise(F.col("loose") + F.pmod(hashed, F.greatest("rest", F.lit(1)))).cast("int")
    return groups.join(sizes, "key").select("ent", "key", blk.alias("blk"), (F.col("loose") + F.col("rest")).alias("blocks"), "loose")


def led(groups: DataFrame, leaders: DataFrame) -> DataFrame:
    """As placed(), for cut groups and their leaders (key, ent): each block's items have query 1 and stand beside their group's leader (query 0)."""
    members = groups.join(leaders.withColumnRenamed("ent", "leader"), "key").where("ent <> leader")
    heads = leaders.join(groups.select("key", "blk").distinct(), "key")
    place = lambda df, query: df.select("key", F.lit(0).alias("blk"), F.col("blk").alias("part"), F.lit(query).alias("query"), "ent")
    return place(heads, 0).unionByName(place(members, 1))


def placed(asks: DataFrame, groups: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """key, blk, part, query, ent: which items have to come together. Each block's members have query 0, items of later
    blocks that ask for its group query 1; these are dealt over parts, and members go to each part. Any two items that may link meet once,
    but for followers of one group, if in part 0 the members are compared with each other, too; blocks of followers have no part 0.
    Followers go to no block of their own group, so what a group's items cost grows with those that aren't followers."""
    own = groups.select(F.col("ent"), F.col("key").alias("own_key"), F.col("blk").alias("own_blk"))
    sizes = groups.select("key", "blocks", "loose").distinct()
    visits = asks.join(sizes, "key").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(own, "ent")
    visits = visits.where("key < own_key or (key = own_key and own_blk < loose and (blk < own_blk or blk >= loose))")
    visits = scratch.table(visits.select("ent", "key", "blk"), "visits")
    parts = visits.groupBy("key", "blk").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    start = F.when(F.col("blk") < F.col("loose"), 0).otherwise(1)
    inside = groups.select("ent", "key", "blk", start.alias("start")).join(parts, ["key", "blk"], "left").withColumn("end", F.col("start") + F.coalesce("parts", 1 - F.col("start")))
    inside = inside.where("end > start").select("key", "blk", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("part"), F.lit(0).alias("query"), "ent")
    outside = visits.join(parts, ["key", "blk"]).join(sizes, "key").select("key", "blk", (start + F.pmod(F.xxhash64("ent"), F.col("parts"))).cast("int").alias("part"), F.lit(1).alias("query"), "ent")
    return scratch.table(inside.unionByName(outside), "placed")


def opened(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, types: pa.Schema) -> DataFrame:
    """Calls fn with the rows of each key, blk, part, sorted by query and ent. rows: placed() and what else fn needs, in this order."""
    rest = [c for c in rows.columns if c not in ("key", "blk", "part", "query", "ent")]
    rows = spread(rows.select("key", "blk", "part", "query", "ent", *rest), "key", "blk", "part").sortWithinPartitions("key", "blk", "part", "query", "ent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        return fn(sections(batches, 3))

    return arrow(rows, run, schema, types)
