"""Beyond the batch engine: transcripts and ticks as streams. Same column functions, with watermarks for late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonefold import schemas
from tonefold.functions import lexical as X


def transcript_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """New transcript files, each (ticker, date) once within the watermark."""
    rows = spark.readStream.schema(schemas.RAW_TRANSCRIPT).option("multiLine", True).json(path).withColumn("ts", F.col("_metadata.file_modification_time"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ticker", "date"])


def scored_stream(transcripts: DataFrame) -> DataFrame:
    return X.with_scores(transcripts.select("ticker", "date", "ts", "raw_text"), F.col("raw_text")).drop("raw_text", "n_tokens")


def bar_stream(ticks: DataFrame, late: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Bars of event-time windows (sliding ones with slide). ticks: ticker, ts, price."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = ticks.withWatermark("ts", late).groupBy(w, "ticker").agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("volume"))
    return agg.select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return ticks.withWatermark("ts", late).groupBy(w, "ticker").agg(F.count("*").alias("n")).select("ticker", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; sink gets each batch and its number, by which it can skip a repeat."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
