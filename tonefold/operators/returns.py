"""Price bars and forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonefold import lexicon as L


def daily_bars(ticks: DataFrame, ticker: Column, ts: Column, price: Column, tie: Column) -> DataFrame:
    """ticker, date, open, high, low, close, volume from ticks; ties in time are broken by tie."""
    t = ticks.select(ticker.alias("ticker"), F.to_date(ts).alias("date"), price.alias("p"), F.struct(ts.alias("ts"), tie.alias("tie")).alias("at"))
    return t.groupBy("ticker", "date").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.count("*").alias("volume"))


def in_universe(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows whose ticker is on the list (tickers: ticker; repeats and case don't matter)."""
    listed = tickers.select(F.upper("ticker").alias("_listed")).where("_listed is not null").distinct()
    return rows.join(listed, F.upper("ticker") == F.col("_listed"), "left_semi")


def price_window(calls: DataFrame, margin_days: int = 15) -> DataFrame:
    """ticker, first_date, last_date: the price range that a ticker's calls need."""
    return calls.groupBy("ticker").agg(F.date_sub(F.min("call_date"), margin_days).alias("first_date"), F.date_add(F.max("call_date"), margin_days).alias("last_date"))


def _backwards(*by: str) -> Window:
    """Bars and calls from the last one back to this one: the last bar met is the next one in time. A frame up to the end would be gone through anew for each row."""
    return Window.partitionBy(*by).orderBy(F.desc("date"), F.desc("is_bar")).rowsBetween(Window.unboundedPreceding, 0)


def entries(calls: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = L.HORIZONS, entry: str = "close") -> DataFrame:
    """Each call with its first bar on or after call_date and the returns from there; calls without such a bar go.

    A forward as-of join in linear time: bars and calls of a ticker are one ordered list (calls before bars of the
    same day), and a call takes the first bar that follows. entry: close (default) or open of that bar.
    """
    per = Window.partitionBy("ticker").orderBy("date")
    leads = [F.lead("close", k).over(per).alias(f"c{k}") for k in horizons]
    bar = bars.select("*", *leads).select("ticker", "date", F.struct(F.col("date").alias("entry_date"), F.col(entry).alias("price"), *[F.col(f"c{k}") for k in horizons]).alias("bar"))
    both = bar.withColumn("is_bar", F.lit(1)).unionByName(calls.select("ticker", F.col("call_date").alias("date"), F.lit(0).alias("is_bar")), allowMissingColumns=True)
    found = both.withColumn("hit", F.last("bar", ignorenulls=True).over(_backwards("ticker"))).where((F.col("is_bar") == 0) & F.col("hit").isNotNull())
    base = F.nullif(F.col("hit.price"), F.lit(0.0))
    return found.select("ticker", F.col("date").alias("call_date"), "hit.entry_date", F.col("hit.price").alias("entry_price"), *[(F.try_divide(F.col(f"hit.c{k}"), base) - 1).alias(f"ret_{k}d") for k in horizons])


def bucketed_entries(calls: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = L.HORIZONS, entry: str = "close", width: int = 64 * 86_400, block: int = 4096) -> DataFrame:
    """As entries(), for bars of any fineness and tickers of any number of bars: no task needs all bars of a ticker.

    calls: ticker, call_date; bars: ticker, date and prices; both dates may be timestamps. A ticker's time is cut into slots of width seconds. A call looks for its bar in its slot; where none
    follows there, it takes the first bar of the next slot that has any, which is carried back over slots, a row each. Bars are numbered by their place in the slot and the counts of the
    slots before; blocks of so many consecutive numbers, with the first bars of the block after, give the bars some places on. Bars of a ticker have different dates.
    """
    reach = max(horizons)
    if not 0 < reach <= block:
        raise ValueError("a block has to hold the farthest horizon")
    slot = F.floor(F.unix_seconds(F.col("date").cast("timestamp")) / width)
    bar = bars.select("ticker", "date", F.col(entry).alias("price"), "close").withColumn("slot", slot)
    sizes = bar.groupBy("ticker", "slot").agg(F.count("*").alias("n"))
    before = sizes.select("ticker", "slot", F.coalesce(F.sum("n").over(Window.partitionBy("ticker").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("ticker", "slot").orderBy("date")) - 1
    numbered = bar.withColumn("place", place).join(before, ["ticker", "slot"]).withColumn("no", F.col("base") + F.col("place")).drop("base", "place")
    own = F.floor(F.col("no") / block)
    both = F.when((F.col("no") % block < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    ahead = Window.partitionBy("ticker", "blk").orderBy("no")
    led = numbered.withColumn("blk", F.explode(both)).withColumns({f"c{k}": F.lead("close", k).over(ahead) for k in horizons}).where(F.col("blk") == own)
    led = led.select("ticker", "slot", "date", F.struct(F.col("date").alias("entry_date"), "price", *[f"c{k}" for k in horizons]).alias("bar"))
    asked = calls.select("ticker", F.col("call_date").alias("date")).withColumn("slot", slot)
    firsts = led.groupBy("ticker", "slot").agg(F.min_by("bar", "date").alias("first"))
    slots = firsts.unionByName(asked.select("ticker", "slot").distinct(), allowMissingColumns=True).groupBy("ticker", "slot").agg(F.first("first", ignorenulls=True).alias("first"))
    later = Window.partitionBy("ticker").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("ticker", "slot", F.last("first", ignorenulls=True).over(later).alias("next"))
    rows = led.withColumn("is_bar", F.lit(1)).unionByName(asked.withColumn("is_bar", F.lit(0)), allowMissingColumns=True)
    found = rows.withColumn("hit", F.last("bar", ignorenulls=True).over(_backwards("ticker", "slot"))).where("is_bar = 0").join(carried, ["ticker", "slot"])
    found = found.withColumn("hit", F.coalesce("hit", "next")).where("hit is not null")
    base = F.nullif(F.col("hit.price"), F.lit(0.0))
    return found.select("ticker", F.col("date").alias("call_date"), "hit.entry_date", F.col("hit.price").alias("entry_price"), *[(F.try_divide(F.col(f"hit.c{k}"), base) - 1).alias(f"ret_{k}d") for k in horizons])


def returns_index(calls: DataFrame, bars: DataFrame, entry: str = "close") -> DataFrame:
    """ticker, call_date (YYYYMMDD), ret_1d, ret_3d, ret_5d of distinct calls."""
    got = entries(calls.select("ticker", "call_date").distinct(), bars, entry=entry)
    return got.select("ticker", F.date_format("call_date", "yyyyMMdd").alias("call_date"), *[f"ret_{k}d" for k in L.HORIZONS])


def null_shares(index: DataFrame) -> DataFrame:
    """Share of missing returns by horizon, and of returns beyond 60 percent."""
    return index.agg(*[F.avg(F.col(f"ret_{k}d").isNull().cast("double")).alias(f"null_{k}d") for k in L.HORIZONS], *[F.avg((F.abs(F.col(f"ret_{k}d")) > 0.6).cast("double")).alias(f"outlier_{k}d") for k in L.HORIZONS])
