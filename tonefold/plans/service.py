"""What the service and the dashboard answer, as functions of a session; HTTP is the caller's."""

from __future__ import annotations

import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold import lexicon as L
from tonefold.functions import text as T
from tonefold.operators import signals as S


class NotFound(LookupError):
    """No rows for a ticker (404)."""


def health(spark: SparkSession, signals: DataFrame | None, lexicon: L.Lexicon | None = L.FINANCE) -> dict[str, bool | str]:
    ready = {"session": spark.range(1).count() == 1, "signals": signals is not None, "lexicon": bool(lexicon)}
    return {"status": "ok" if all(ready.values()) else "degraded", **ready}


def authorized(key: str | None, expected: str) -> bool:
    """Whether a request's API key is the expected one, compared in constant time; an empty expected key admits nobody."""
    return bool(expected) and hmac.compare_digest((key or "").encode(), expected.encode())


def analyze(spark: SparkSession, text: str, ticker: str = "ADHOC", lexicon: L.Lexicon = L.FINANCE) -> DataFrame:
    """One row: signals of a text whose sentences (over three words) all count as the CEO's remarks; total_words, sentences_parsed."""
    if len(text or "") < 50:
        raise ValueError("the text has fewer than 50 characters")
    if not lexicon:
        raise RuntimeError("no lexicon is loaded")
    doc = spark.createDataFrame([(ticker, text)], "ticker string, raw_text string")
    sents = doc.select("ticker", F.explode(T.split_sentences(T.clean_text(F.col("raw_text")))).alias("text"))
    sents = sents.where(T.word_count(F.col("text")) > 3).select("ticker", F.lit("adhoc").alias("date"), F.lit("ceo").alias("speaker_role"), F.lit("remarks").alias("section"), "text", T.word_count(F.col("text")).alias("word_count"))
    totals = sents.groupBy("ticker").agg(F.sum("word_count").alias("total_words"), F.count("*").alias("sentences_parsed"))
    return S.transcript_signals(S.scored(sents, lexicon)).drop("has_qa", "certainty", "specificity").join(totals, "ticker")


def analyze_all(requests: DataFrame, lexicon: L.Lexicon = L.FINANCE) -> DataFrame:
    """As analyze() for a table of requests (id, text; ids are unique): id, status (ok, or too_short for fewer than 50 characters or none), signals, total_words, sentences_parsed.
    Requests that are too short, and texts without a sentence of over three words, have no signals."""
    held = requests.select("id", "text", F.when(F.length("text") >= 50, "ok").otherwise("too_short").alias("status"))
    sents = held.where("status = 'ok'").select("id", F.explode(T.split_sentences(T.clean_text(F.col("text")))).alias("text")).withColumn("word_count", T.word_count(F.col("text"))).where("word_count > 3")
    sents = sents.withColumns({"speaker_role": F.lit("ceo"), "section": F.lit("remarks")})
    scored = S.scored(sents, lexicon)
    found = S.transcript_signals(scored, ("id",)).drop("has_qa", "certainty", "specificity")
    totals = scored.groupBy("id").agg(F.sum("word_count").alias("total_words"), F.count("*").alias("sentences_parsed"))
    out = held.drop("text").join(found.join(totals, "id"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_words", "sentences_parsed")})


def signals_of(signals: DataFrame, ticker: str) -> DataFrame:
    """All rows of a ticker, case ignored; NotFound if there are none. On Parquet by ticker, the filter reaches the scan for upper-case names."""
    found = signals.where(F.upper("ticker") == ticker.upper())
    if found.isEmpty():
        raise NotFound(ticker)
    return found


def signal_on(signals: DataFrame, ticker: str, date: str) -> DataFrame:
    return signals_of(signals, ticker).where(F.col("call_date") == date)


def key_figures(best: DataFrame) -> DataFrame:
    """The dashboard's four figures, of the best configuration."""
    return best.select("annualized_sharpe_ratio", "cumulative_return", "win_rate", "total_trades", "actual_signal_used", "holding_period")


def signal_table(signals: DataFrame) -> DataFrame:
    return signals.orderBy("ticker", "call_date")
