"""N-gram Jaccard join over a token-group matrix.

Distinct shingle sets that share a rare shingle are gathered into groups. The token-group matrix is a table: which of the rare shingles (those
of a set's prefix, by which sets that link must meet) any member of a group has. A query set's shingles in a group's row bound what
it shares with any member; only groups whose bound reaches the need are opened, block by block, where the union of a block's whole sets bounds the overlap
again before members are compared exactly.

Null and empty texts, and texts without words, have no shingles and link with nothing (each is its own
component). Texts may be of any length. Repeated rows stay repeated. A null doc_id is carried along; it counts as smallest only
where every member of a component has one. Of a component's documents the smallest doc_id names it, so there are no ties but those of repeated
doc_ids, which stay or go together. Other columns, whatever their names, are ignored by components() and kept by keep_first().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components as connected
from .setjoin import Rule, joined_sets, similar_edges


def components(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 128) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id of every row.

    component_id is the smallest doc_id reachable over links (100 * intersection >= percent * union).
    """
    rule = Rule(words, percent, False, block)
    scratch = Scratch(docs.sparkSession, "ngram")
    join = joined_sets(docs, rule, scratch)
    roots = connected(similar_edges(join, rule, scratch), scratch)
    by_sig = join.firsts.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "low", "sig2")
    least = by_sig.groupBy("root").agg(F.min("low").alias("component_id"))
    named = scratch.table(by_sig.join(least, "root").select("sig", "sig2", "component_id"), "named")
    rows = join.items.join(named, ["sig", "sig2"], "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 128) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without a doc_id and documents without words stay.
    Rows that repeat a doc_id stay or go together."""
    scratch = Scratch(docs.sparkSession, "ngram-keep")
    found = components(docs, words, percent, block)
    key = f"_gone_{uuid.uuid4().hex[:8]}"
    gone = scratch.table(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")
