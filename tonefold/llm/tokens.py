"""Token counts by separator scan.

Token files are flat: little-endian unsigned integers of one width, a document's tokens followed by an end-of-document
id, and no index. A file is cut into blocks of fixed size, and each block is searched for the id with one vectorised
comparison. Documents that run across blocks are stitched by a prefix scan over the blocks of a file: the
running maximum of separator positions gives the token at which a block's first document began, the running
sum of separator counts the number of that document in the file.

A file that doesn't end with a separator ends with an unfinished document, which is counted, too (finished: false).
Empty documents have 0 tokens; empty files hold none. A null text is an empty document; a repeated row is written again
and counted again; a document may run over any number of blocks. Documents stand in a file in the order in which a task
reads them, so there are no ties. A null doc_id is carried along; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, arrow
from .warc import opened

#: Bytes of a file that one search covers.
BLOCK = 4 << 20


def width_of(tokenizer: str, eod: int) -> int:
    """Bytes of an id: 2 where all ids of the tokenizer and the separator fit."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    return 2 if max(eod, *spec["model"]["vocab"].values()) < 1 << 16 else 4


def write(docs: DataFrame, folder: str, tokenizer: str, eod: int, width: int = 4) -> DataFrame:
    """Writes token files (ids of width bytes, one file a task, under a name of its own). Returns file, ordinal, doc_id of every document, and for each file a row with its size.

    Lazily: materialise it, as each run writes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc, end = encoder(tokenizer), np.array([eod], f"<u{width}").tobytes()
        where, at = opened(folder)
        where.create_dir(at, recursive=True)
        name, n, size = f"{uuid.uuid4().hex}.bin", 0, 0
        with where.open_output_stream(f"{at}/{name}", compression=None) as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    ids = enc.ordinary(text or "")
                    size += out.write((ids if width == 4 else np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()) + end)
                k = batch.num_rows
                yield {"file": [f"{folder}/{name}"] * k, "ordinal": np.arange(n, n + k), "doc_id": batch.column(0), "size": [None] * k}
                n += k
        yield {"file": [f"{folder}/{name}"], "ordinal": [None], "doc_id": [None], "size": [size]}

    types = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64())])
    return arrow(docs.select("doc_id", "text"), run, "file string, ordinal long, doc_id long, size long", types)


def count(files: DataFrame, eod: int, width: int = 4, block: int = BLOCK) -> DataFrame:
    """files: file, size (bytes). Returns file, ordinal, n_tokens, finished of every document, from the files alone."""
    block -= block % width
    starts = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("at"))
    starts = starts.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for file, size, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                where, path = opened(file)
                with where.open_input_file(path) as f:
                    raw = f.read_at(min(block, size - at), at)
                ids = np.frombuffer(raw, f"<u{width}", len(raw) // width)
                ends = np.flatnonzero(ids == eod) + at // width
                yield {"file": [file], "at": [at // width], "ends": [ends], "n": [len(ends)], "last": [int(ends[-1]) if len(ends) else None], "total": [size // width]}

    types = pa.schema([("file", pa.string()), ("at", pa.int64()), ("ends", pa.list_(pa.int64())), ("n", pa.int64()), ("last", pa.int64()), ("total", pa.int64())])
    found = arrow(starts, run, "file string, at long, ends array<long>, n long, last long, total long", types)
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    found = found.withColumn("from", F.coalesce(F.max("last").over(before), F.lit(-1))).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("more", F.count("*").over(after))
    done = found.select("file", "base", "from", "ends", F.posexplode("ends").alias("k", "end"))
    prev = F.when(F.col("k") == 0, F.col("from")).otherwise(F.expr("ends[k - 1]"))
    done = done.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("end") - prev - 1).alias("n_tokens"), F.lit(True).alias("finished"))
    final = F.coalesce("last", "from")
    rest = found.where((F.col("more") == 0) & (final < F.col("total") - 1))
    rest = rest.select("file", (F.col("base") + F.col("n")).alias("ordinal"), (F.col("total") - 1 - final).alias("n_tokens"), F.lit(False).alias("finished"))
    return done.unionByName(rest)


def counted(docs: DataFrame, tokenizer: str, eod: int, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens of every row of docs: writes token files to the shared folder and scans them."""
    scratch = Scratch(docs.sparkSession, "tokens")
    width = width_of(tokenizer, eod)
    rows = scratch.table(write(docs, f"{scratch.root}/files", tokenizer, eod, width), "manifest")
    found = scratch.table(count(rows.where("size is not null").select("file", "size"), eod, width, block), "counts")
    where, at = opened(f"{scratch.root}/files")
    where.delete_dir(at)  # all that is asked of them has been written
    return rows.where("ordinal is not null").join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
