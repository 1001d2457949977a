"""Sinks. Sentences are partitioned by ticker, prices by a hash of it, both written with dynamic overwrite, so that a rerun replaces only what it holds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold import lexicon as L
from tonefold import schemas
from tonefold.functions.text import clean_ticker
from tonefold.operators.stats import keep_first, not_yet_stored
from tonefold.sources import keyed


def write_raw(raw: DataFrame, path: str, stored: DataFrame | None = None, order: tuple[str, ...] = ("dataset_row_id",)) -> None:
    """Appends transcripts by (ticker, date), the first of each key, none that is stored already. Tickers keep letters, digits and underscores only."""
    new = keep_first(raw.withColumn("ticker", clean_ticker(F.col("ticker"))), order)
    new = new if stored is None else not_yet_stored(new, stored)
    new.write.mode("append").json(path)


def write_raw_files(raw: DataFrame, path: str, order: tuple[str, ...] = ("dataset_row_id",), least_bytes: int = 1000) -> None:
    """A JSON file {ticker}_{date}.json for each key, the first of its rows, all or nothing (see keyed). Rows without a ticker or a date are keyed as unknown."""
    known = raw.withColumn("ticker", F.coalesce(F.nullif(clean_ticker(F.col("ticker")), F.lit("")), F.lit("UNKNOWN"))).withColumn("date", F.coalesce("date", F.lit("19000101")))
    keyed.write(keep_first(known, order), path, least_bytes)


def _by_ticker(df: DataFrame, path: str) -> None:
    df.repartition("ticker", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def write_sentences(sents: DataFrame, path: str) -> None:
    _by_ticker(sents, path)


#: Folders of a price store and files in each that a write makes at most. A store's folders can't be changed later.
PRICE_PARTS, PART_FILES = 32, 8


def write_prices(bars: DataFrame, path: str) -> None:
    """Bars in folders by a hash of the ticker (part), sorted by ticker and date: so many files however many tickers there are. Tickers of the store that
    bars holds are replaced; others stay, those of folders that are written anew are written again."""
    new = bars.withColumn("part", F.pmod(F.xxhash64("ticker"), F.lit(PRICE_PARTS)).cast("int"))
    try:
        stored = bars.sparkSession.read.schema(f"{schemas.OHLCV}, part int").parquet(path)
        tickers, same = new.select(F.col("ticker").alias("_new")).distinct(), F.col("ticker").eqNullSafe(F.col("_new"))
        kept = stored.join(F.broadcast(new.select("part").distinct()), "part", "left_semi").join(tickers, same, "left_anti")  # PRICE_PARTS numbers
        new = new.unionByName(kept, allowMissingColumns=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    dealt = new.repartition("part", F.pmod(F.xxhash64(*bars.columns), F.lit(PART_FILES))).sortWithinPartitions("part", "ticker", "date")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_returns(index: DataFrame, path: str) -> None:
    """Range-partitioned and sorted by (ticker, call_date), so readers can skip files."""
    index.repartitionByRange("ticker", "call_date").sortWithinPartitions("ticker", "call_date").write.mode("overwrite").parquet(path)


def write_signals(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").parquet(path)


def write_matcher(spark: SparkSession, path: str, lexicon: L.Lexicon = L.FINANCE) -> None:
    """The hedge matcher as data: rows label, phrase. readers.matcher() makes its pattern again."""
    phrases = sorted({*L.HEDGE_PHRASES, *L.hedge_words(lexicon)})
    spark.createDataFrame([("HEDGE", p) for p in phrases], "label string, phrase string").coalesce(1).write.mode("overwrite").json(path)


def write_results(results_json: DataFrame, path: str) -> None:
    """results_json(): one row of text."""
    results_json.coalesce(1).write.mode("overwrite").text(path)
