"""What the operators share: scratch tables in the cluster's shared folder, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows of a text column that go to Python at once; a batch stays small however long its texts are.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # a single machine, as in tests: a folder that goes with the process
        folder = tempfile.mkdtemp(prefix="tonefold-")
        atexit.register(shutil.rmtree, folder, True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def wide(spark: SparkSession) -> Iterator[None]:
    """Larger Arrow batches for rows of a few numbers, while a table is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder in place of caches: they survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        tune(spark)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again, which also cuts its lineage."""
        path = self.path(name)
        df.write.option("compression", "lz4").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if (jvm := getattr(self.spark, "_jvm", None)) is not None:  # not with Connect
            jvm.System.gc()  # Spark deletes shuffle files when the driver collects what refers to them, else after 30 minutes
        return out


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deals rows out by cols; how many partitions there are is left to the session and to adaptive execution."""
    return df.repartition(*cols)


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, types: pa.Schema) -> DataFrame:
    """mapInArrow with a function that yields dicts of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in types], schema=types)

    return df.mapInArrow(run, schema)


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column (an integer), batches that hold all rows of each key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # rows of the last key may go on
        if held and (cut or held[0].column(0)[0].as_py() != key[0]):
            yield joined([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield joined(held)


def sections(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first columns (integers), the rows of each key, one after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = np.flatnonzero(change)
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(c[a] for c in cols) if a else first
            if held and key != last:
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row's do."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        for _ in range(2):
            x = x ^ (x >> np.uint64(32))
            x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class WordHashes:
    """Words (runs outside [\\x20\\x09-\\x0D]) of a byte string and their 64-bit hashes, by array operations.

    A word is read eight bytes at a time, what lies behind its end masked out; words of LONG bytes or more are hashed one by one.
    """

    LONG = 256

    def __init__(self) -> None:
        self.mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words."""
        raw = np.zeros(len(text) + 8, np.uint8)
        raw[: len(text)] = np.frombuffer(text, np.uint8)
        blank = np.ones(len(text) + 2, bool)
        np.less(raw[: len(text)] - np.uint8(9), 5, out=blank[1:-1])  # 9 to 13
        blank[1:-1] |= raw[: len(text)] == 32
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        start, size = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray((len(text) + 1,), "<u8", buffer=raw, strides=(1,))
        with np.errstate(over="ignore"):
            out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out ^= eight[start] & self.mask[np.minimum(size, 8)]
            more, k = np.flatnonzero((size > 8) & (size < self.LONG)), 8
            while len(more):
                x = out[more]
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out[more] = (x ^ (x >> np.uint64(32))) + (eight[start[more] + k] & self.mask[np.minimum(size[more] - k, 8)])
                k += 8
                more = more[size[more] > k]
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        for i in np.flatnonzero(size >= self.LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + size[i]])
        return out, start


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null: empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]
