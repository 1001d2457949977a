"""Transcripts to lines, speaker blocks and sentences.

All windows of a transcript share one partitioning (its key), so the planner needs one exchange for them. A block
takes the section in force where it ends: a header's own section marker counts for the block before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonefold.functions import text as T

KEY = ("ticker", "date")


def lines(raw: DataFrame, key: tuple[str, ...] = KEY, least_chars: int = 0) -> DataFrame:
    """key, line_no, line, boilerplate: the cleaned text's lines, from 0. Texts under least_chars are left out."""
    long = raw.where(F.length("raw_text") >= least_chars) if least_chars else raw
    return long.select(*key, F.posexplode(F.split(T.clean_text(F.col("raw_text")), "\n")).alias("line_no", "line")).withColumn("boilerplate", T.is_boilerplate(F.col("line")))


def annotated(raw: DataFrame, key: tuple[str, ...] = KEY, least_chars: int = 0) -> DataFrame:
    """Surviving lines with marker, header fields, cue and the running section before and after a header's cue."""
    df = lines(raw, key, least_chars).where(~F.col("boilerplate")).drop("boilerplate")
    line = F.col("line")
    df = df.withColumn("marker", T.section_marker(line)).withColumn("is_header", T.is_header(line))
    df = df.withColumn("speaker_name", F.when(F.col("is_header"), T.speaker_name(line))).withColumn("hint", F.when(F.col("is_header"), T.role_hint(line)))
    df = df.withColumn("speaker_role", F.when(F.col("is_header"), T.speaker_role(F.col("speaker_name"), F.col("hint"))))
    cue = F.when(F.col("speaker_role") == "analyst", "qa").when(F.col("speaker_role").isin("ceo", "cfo"), "remarks")
    df = df.withColumn("cue", cue)
    here = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("marker", ignorenulls=True).over(here)
    df = df.withColumn("section_after", F.coalesce(last, F.first("cue", ignorenulls=True).over(here), F.lit("unknown")))
    df = df.withColumn("section_flush", F.coalesce(last, F.first("cue", ignorenulls=True).over(before), F.lit("unknown")))
    return df.withColumn("block", F.sum(F.col("is_header").cast("int")).over(here))


def blocks(marked: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """key, block, speaker_name, speaker_role, section, text of blocks that have body lines. marked: annotated()."""
    by_line = lambda c: F.max_by(c, "line_no")
    body = F.when(~F.col("is_header"), F.struct("line_no", T.strip(F.col("line")).alias("t")))
    per = marked.groupBy(*key, "block").agg(
        F.min_by("section_flush", "line_no").alias("opened_as"),
        by_line("section_after").alias("closed_as"),
        F.max("speaker_name").alias("name"),
        F.max("speaker_role").alias("role"),
        F.array_sort(F.collect_list(body)).alias("body"),
    )
    following = F.lead("opened_as").over(Window.partitionBy(*key).orderBy("block"))
    text = T.strip(F.array_join(F.transform("body", lambda x: x["t"]), " "))
    out = per.select(*key, "block", F.coalesce("name", F.lit("unknown")).alias("speaker_name"), F.coalesce("role", F.lit("other")).alias("speaker_role"), F.coalesce(following, "closed_as").alias("section"), text.alias("text"))
    return out.where(F.col("text") != "")


def sentences(found: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """sentence_id (dense from 0 in a transcript), key, speaker_role, speaker_name, section, text, word_count. found: blocks()."""
    parts = found.select(*key, "block", "speaker_role", "speaker_name", "section", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "text"))
    parts = parts.where(T.keeps_sentence(F.col("text")))
    order = Window.partitionBy(*key).orderBy("block", "pos")
    return parts.select((F.row_number().over(order) - 1).alias("sentence_id"), *key, "speaker_role", "speaker_name", "section", "text", T.word_count(F.col("text")).alias("word_count"))


def preprocess(raw: DataFrame, key: tuple[str, ...] = KEY, least_chars: int = 200) -> DataFrame:
    """Raw transcripts to sentences."""
    return sentences(blocks(annotated(raw, key, least_chars), key), key)


def role_section_counts(sents: DataFrame) -> DataFrame:
    return sents.groupBy("speaker_role", "section").agg(F.count("*").alias("n_sentences"), F.sum("word_count").alias("n_words"))


def preprocessing_stats(raw: DataFrame, sents: DataFrame, key: tuple[str, ...] = KEY, least_chars: int = 200) -> DataFrame:
    """One row: transcripts processed, skipped as short, without sentences; sentences in all and on average."""
    per = raw.select(*key, (F.coalesce(F.length("raw_text"), F.lit(0)) < least_chars).alias("short")).join(sents.groupBy(*key).agg(F.count("*").alias("n")), list(key), "left")
    done = ~F.col("short") & F.col("n").isNotNull()
    return per.agg(F.count_if(done).alias("processed"), F.count_if("short").alias("skipped"), F.count_if(~F.col("short") & F.col("n").isNull()).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"), F.coalesce(F.try_divide(F.sum("n").cast("double"), F.count_if(done)), F.lit(0.0)).alias("avg_sentences"))


def ordered_text(rows: DataFrame, key: tuple[str, ...], order: str, text: Column, sep: str = "\n") -> DataFrame:
    """key and the texts of a key's rows, joined in order."""
    got = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("rows"))
    return got.select(*key, F.array_join(F.transform("rows", lambda x: x["t"]), sep).alias("raw_text"))
