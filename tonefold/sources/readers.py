"""Sources: transcripts, sentences, prices, dictionaries. Schemas are given, never inferred; bad rows are counted, not fatal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold import lexicon as L
from tonefold import schemas
from tonefold.functions import text as T
from tonefold.functions.lexical import alternation


def raw_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file. Files that don't parse are rows whose fields are null; see bad_files()."""
    return spark.read.schema(schemas.RAW_TRANSCRIPT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def bad_files(raw: DataFrame) -> DataFrame:
    return raw.where("raw_text is null and ticker is null").agg(F.count("*").alias("bad_files"))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of sentence records, or Parquet."""
    if path.rstrip("/").endswith("parquet"):
        return spark.read.schema(schemas.SENTENCE).parquet(path)
    return spark.read.schema(schemas.SENTENCE).option("multiLine", True).json(path)


def prices(spark: SparkSession, path: str) -> DataFrame:
    """The seven canonical columns of price bars, whatever else the files hold."""
    canonical = [c.split()[0] for c in schemas.OHLCV.split(", ")]
    return spark.read.schema(schemas.OHLCV).parquet(path).select(*canonical)


def signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SIGNAL).parquet(path)


def with_fallback(primary: DataFrame, secondary: DataFrame, key: str = "ticker") -> DataFrame:
    """Bars of the primary source; of the secondary one for keys that the primary lacks."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


# Which dictionary columns are which category; names of the word column.
CATEGORY_COLUMNS = {
    "negative": r"^negative$",
    "positive": r"^positive$",
    "uncertainty": r"^uncertaint",
    "litigious": r"^litigious$",
    "strong_modal": r"strong.modal|modal.strong",
    "weak_modal": r"weak.modal|modal.weak",
    "constraining": r"^constraining$",
}
WORD_COLUMNS = ("word", "term", "word_flag", "word_flag2")


def dictionary(spark: SparkSession, path: str, positive_only: bool = False) -> DataFrame:
    """category, word of a master dictionary in CSV: alphabetic words with a non-zero integer in a category's column
    (negative numbers count unless positive_only)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    word = next((c for c in df.columns if c.lower() in WORD_COLUMNS), df.columns[0])
    of = {c: next((k for k, p in CATEGORY_COLUMNS.items() if re.search(p, c, re.IGNORECASE)), None) for c in df.columns}
    cells = [F.struct(F.lit(k).alias("category"), F.col(f"`{c}`").alias("v")) for c, k in of.items() if k]
    rows = df.select(F.lower(T.strip(F.col(f"`{word}`"))).alias("word"), F.explode(F.array(*cells)).alias("x")).select("x.category", "word", T.strip(F.col("x.v")).try_cast("int").alias("v"))
    return rows.where(F.col("word").rlike(r"^\p{L}+$") & ((F.col("v") > 0) if positive_only else (F.col("v") != 0))).select("category", "word").distinct()


def as_lexicon(words: DataFrame, least: int = 100) -> L.Lexicon:
    """A dictionary's words by category (some thousands in all); the built-in ones if there are fewer than least."""
    rows = words.groupBy("category").agg(F.array_sort(F.collect_set("word")).alias("words")).collect()
    found = {r.category: list(r.words) for r in rows}
    return found if sum(map(len, found.values())) >= least else L.FINANCE


def store_lexicon(spark: SparkSession, lexicon: L.Lexicon, path: str) -> None:
    """Writes a lexicon as rows category, word."""
    rows = [(k, w) for k, words in lexicon.items() for w in words]
    spark.createDataFrame(rows, "category string, word string").coalesce(1).write.mode("overwrite").parquet(path)


def stored_lexicon(spark: SparkSession, path: str, make: Callable[[], DataFrame] | None = None, least: int = 100) -> L.Lexicon:
    """The lexicon stored at path. If there is none yet, that of make() (rows category, word), which is stored; without make(), or with fewer than
    least words, the built-in one."""
    try:
        return as_lexicon(spark.read.schema("category string, word string").parquet(path), least)
    except AnalysisException:  # no such path
        if make is None:
            return L.FINANCE
    found = as_lexicon(make(), least)
    store_lexicon(spark, found, path)
    return found


def matcher(spark: SparkSession, path: str, label: str = "HEDGE") -> str:
    """The pattern of a stored matcher (some hundred phrases), for lexical.hedge_spans()."""
    rows = spark.read.schema("label string, phrase string").json(path).where(F.col("label") == label).collect()
    return alternation({r.phrase for r in rows})


def united_splits(splits: list[DataFrame], row: str, limit: int, least_chars: int = 200) -> DataFrame:
    """normalized() of the first `limit` rows of all splits, one after another (columns may differ); of these, texts over least_chars."""
    tagged = [s.withColumn("_split", F.lit(i)) for i, s in enumerate(splits)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    first = every.orderBy("_split", row).limit(limit).drop("_split")
    return normalized(first, F.col(row), least_chars=least_chars)


def normalized(rows: DataFrame, row: Column, text: tuple[str, ...] = ("transcript", "text", "content", "body", "input"), ticker: tuple[str, ...] = ("ticker", "symbol", "company_ticker"), least_chars: int = 100, limit: int | None = None) -> DataFrame:
    """Records of any columns to ticker, date, raw_text, source, dataset_row_id; texts up to least_chars go."""
    have = lambda names: [F.col(c) for c in names if c in rows.columns]
    others = [F.col(c) for c, t in rows.dtypes if t == "string" and c not in text]
    body = T.first_text(have(text), others) if have(text) or others else F.lit(None).cast("string")
    date = T.normalize_date(F.coalesce(*have(("date", "call_date", "published")), F.lit("")))
    out = rows.select(T.normalize_ticker(*have(ticker), row=row).alias("ticker"), date.alias("date"), body.alias("raw_text"), (F.col("source") if "source" in rows.columns else F.lit("dataset")).alias("source"), row.cast("bigint").alias("dataset_row_id"))
    out = out.where(F.length("raw_text") > least_chars)
    return out if limit is None else out.orderBy("dataset_row_id").limit(limit)
