"""The engine's relations as views of the fixture tables; queries.py has the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold.operators.diarize import ordered_text
from tonefold.operators.returns import daily_bars

# Fixed values, shared with the SQL views: finance words planted in the prose, in this order.
PLANTED = [
    (" this ", " may "), (" with ", " growth "), (" was ", " risk "), (" is ", " must "), (" for ", " expect "), (" from ", " subject to "),
    (" by ", " loss "), (" that ", " we believe "), (" de ", " record "), (" der ", " decline "), (" la ", " strong "), (" die ", " could be "),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planted(c: Column) -> Column:
    for a, b in PLANTED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def raw_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, raw_text, source, dataset_row_id: a transcript for each conversation."""
    conv, turn = F.col("conv_id"), F.col("turn")
    header = F.when(F.col("role") == "user", "Cy Poe: Analyst").when(F.col("role") == "system", "Operator:").when(conv % 2 == 0, "Ann Lee: Chief Executive Officer").otherwise("Bo Roe: Chief Financial Officer")
    before = F.when(turn == 0, "Good morning; prepared remarks of 2024 follow.\n").when(turn == 2, "We will now begin the question-and-answer session, part 2.\n").otherwise("")
    after = F.when(turn == 0, "\nCopyright 2024 by the speakers").when((turn + conv) % 3 == 1, F.concat(F.lit("\nRevenue grew "), (conv % 17).cast("string"), F.lit("% to $2.3B,  “ahead of plan” – again."))).otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(before, header, F.lit("\n"), planted(F.coalesce("text", F.lit(""))), after).alias("t"))
    text = ordered_text(rows, ("conv_id",), "turn", F.col("t"))
    day = F.date_add(F.lit("2019-01-01").cast("date"), (conv * 13 % 1825).cast("int"))
    return text.select(F.concat(F.lit("TK"), (conv % 37).cast("string")).alias("ticker"), F.date_format(day, "yyyyMMdd").alias("date"), "raw_text", F.concat(F.lit("set"), (conv % 3).cast("string"), F.lit("/part")).alias("source"), conv.alias("dataset_row_id"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of events: a user is a ticker, 10,000 plus an event's value a price."""
    events = table(spark, sf_dir, "events")
    return daily_bars(events, F.concat(F.lit("U"), F.col("user_id").cast("string")), F.col("ts"), F.coalesce("value", F.lit(0.0)) + 10000.0, F.col("event_id"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, call_date: the day before each sign-up."""
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.date_sub(F.to_date("ts"), 1).alias("call_date")).distinct()


def stand_in_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, call_date (YYYYMMDD) and numeric signals from the bar of the day after."""
    b = bars(spark, sf_dir)
    return b.select("ticker", F.date_format(F.date_sub("date", 1), "yyyyMMdd").alias("call_date"), (F.col("close") - F.col("open")).alias("confidence_score"), (F.col("high") - F.col("low")).alias("qa_sentiment"), F.col("volume").cast("double").alias("hedge_density"), (F.col("open") - 10000.0).alias("ceo_cfo_divergence"))
