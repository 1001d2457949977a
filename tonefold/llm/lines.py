"""Line dedup by an exact set-similarity join.

The tokens of a line are its word shingles (k words; shorter lines are one token). They are ordered by rarity over
the whole corpus; length, prefix and positional filters and the union of a block's tokens leave
the lines that can reach the threshold, whose Jaccard is then counted exactly. A line goes if an earlier line, by (doc_id, row, line number), has the same tokens or a Jaccard
of at least percent / 100, whether that line itself stays or goes.

Lines are what newline characters separate; lines without words always stay. A null text stays null and has no lines, an empty text has one
without words. Texts and lines may be of any length. Rows with the same doc_id and text count as one document and lose the same lines; rows of one doc_id with
different texts are documents of their own, in order of a hash of their texts. Rows without a doc_id come before all others.
So no two lines are tied. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .setjoin import Rule, joined_sets, later_sets

#: Lines of a block at most, about.
BLOCK = 128


def removed_lines(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, row (see keyed()), gone (line numbers from 0) of rows that lose lines."""
    rule = Rule(words, percent, True, block)
    join = joined_sets(docs, rule, scratch)
    later = later_sets(join, rule, scratch).withColumn("late", F.lit(True))
    first = join.firsts.select("sig", "sig2", F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("item").alias("i"), "copies")
    fate = scratch.table(first.join(later, ["sig", "sig2"], "left").where("late or copies > 1").drop("copies"), "fate")
    rows = join.items.where("sig is not null").select("sig", "sig2", "doc_id", "row", "item").join(fate, ["sig", "sig2"])
    rows = rows.where("late or not (doc_id <=> d and row = r and item = i)")
    return rows.groupBy("doc_id", "row").agg(F.collect_set("item").alias("gone"))  # as many as a document has lines


def dedup(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """docs with texts that lack the removed lines, and columns n_lines, n_removed, n_left (lines with words that stay); these replace columns of docs with such names."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed", "n_left")])
    scratch = Scratch(docs.sparkSession, "lines")
    key, row, out_of = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("id", "row", "gone"))
    gone = scratch.table(removed_lines(docs, scratch, words, percent, block), "gone").toDF(key, row, out_of).hint("shuffle_hash")
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(row)), "left").drop(key, row)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed, left = [], [], [], []
            for text, g in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                parts = [] if text is None else text.split("\n")
                out = set(g or ())
                kept = [x for i, x in enumerate(parts) if i not in out]
                texts.append(None if text is None else "\n".join(kept))
                lines.append(len(parts))
                removed.append(len(parts) - len(kept))
                left.append(sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in kept))
            cols = [pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.int64())], names=[*names, "n_lines", "n_removed", "n_left"])

    more = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_left")]
    return both.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def strip(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with deduplicated texts, without the documents that lost all their lines with words; n_chars, where docs has it, is counted anew.
    Columns n_lines, n_removed, n_left of docs are kept."""
    held = {c: f"_{c}_{uuid.uuid4().hex[:8]}" for c in ("n_lines", "n_removed", "n_left") if c in docs.columns}
    out = dedup(docs.withColumnsRenamed(held), words, percent).where("n_removed = 0 or n_left > 0").drop("n_lines", "n_removed", "n_left").withColumnsRenamed({v: k for k, v in held.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
