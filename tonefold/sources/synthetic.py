"""Synthetic transcripts: rows of spark.range() and hash arithmetic, so any number of them, in parallel and repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Opening remarks and dialogue; {c} company, {n} a number.
REMARKS = (
    "Good afternoon and thank you for joining our quarterly call.",
    "Ann Lee: Chief Executive Officer",
    "We delivered record revenue of ${n} million and strong margin growth this quarter.",
    "We must invest, and we will certainly keep our commitments.",
    "Our outlook may depend on market conditions and we expect volatility.",
    "Bo Roe: Chief Financial Officer",
    "Operating costs increased by {n} percent because of restructuring losses.",
    "Cash flow was robust and the balance sheet is solid.",
)
DIALOGUE = (
    "We will now begin the question-and-answer session.",
    "Cy Poe: Analyst",
    "Could you clarify whether the decline in orders is a risk for next year?",
    "Ann Lee: Chief Executive Officer",
    "We believe the weakness could be temporary, subject to demand.",
    "Cy Poe: Analyst",
    "Thank you, that is helpful and we see good progress.",
)


def _pick(seed: int, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))


def transcripts(spark: SparkSession, n: int, tickers: int = 37, seed: int = 42) -> DataFrame:
    """ticker, date (2019-01-01 and up to 1,825 days on), raw_text, source, dataset_row_id."""
    number = (_pick(seed, "n", 900) + 100).cast("string")
    text = F.replace(F.lit("\n".join(REMARKS + DIALOGUE)), F.lit("{n}"), number)
    day = F.date_add(F.lit("2019-01-01").cast("date"), _pick(seed, "day", 1826).cast("int"))
    rows = spark.range(n)
    return rows.select(F.format_string("TK%02d", _pick(seed, "ticker", tickers)).alias("ticker"), F.date_format(day, "yyyyMMdd").alias("date"), text.alias("raw_text"), F.lit("synthetic/template").alias("source"), F.col("id").alias("dataset_row_id"))
