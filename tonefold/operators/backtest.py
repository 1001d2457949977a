"""Long/short backtests, honestly: reported figures are what the trades give, with no floor and no drawn-in curves.

The grid is one job: signals and horizons are unpivoted into rows (config, s, r), thresholds are computed by
configuration and joined back, and every figure is an aggregate by configuration. Quantiles and ranks need several passes over the rows; calls with their signals and returns are
therefore written to the shared folder once (held()) and unpivoted from there in each pass, so the joins that make them run once.
Spark takes unpivoted rows for as small as the calls that they come from, and would send them all to the driver to broadcast them: joins with figures of
groups (cuts, asked slices, thresholds; a few rows a group) and of days (a row for each day of a configuration) therefore name the side that is broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonefold import lexicon as L
from tonefold import shared

RETURNS = tuple(f"ret_{k}d" for k in L.HORIZONS)


def merged(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """Inner join by (ticker, call_date); unparsable dates go. trade_date is the date as such."""
    both = signals.join(returns, ["ticker", "call_date"])
    return both.withColumn("trade_date", F.try_to_date("call_date", "yyyyMMdd")).where(F.col("trade_date").isNotNull())


def holding_days(c: Column) -> Column:
    return F.regexp_extract(c, r"ret_(\d+)d", 1).try_cast("int")


def held(data: DataFrame, *columns: str) -> DataFrame:
    """ticker, call_date and the given columns of data, as a written table: what is read in several passes."""
    return shared.written(data.select("ticker", "call_date", *[c for c in dict.fromkeys(columns) if c not in ("ticker", "call_date")]), "calls")


def configurations(data: DataFrame, signals: tuple[str, ...] = L.SIGNALS, horizons: tuple[str, ...] = RETURNS, inverse: tuple[bool, ...] = (False, True)) -> DataFrame:
    """Rows config (its place in the grid), signal_column, holding_period, actual_signal_used, s, r, ticker, call_date."""
    cells = []
    for i, s in enumerate(signals):
        for j, h in enumerate(horizons):
            for k, inv in enumerate(inverse):
                n = (i * len(horizons) + j) * len(inverse) + k
                value = F.col(s).cast("double")
                cells.append(F.struct(F.lit(n).alias("config"), F.lit(s).alias("signal_column"), F.lit(h).alias("holding_period"), F.lit(f"Inverse_{s}" if inv else s).alias("actual_signal_used"), (-value if inv else value).alias("s"), F.col(h).alias("r")))
    return data.select("ticker", "call_date", F.explode(F.array(*cells)).alias("x")).select("ticker", "call_date", "x.*").where("s is not null and r is not null")


#: Slices of values into which a group is cut, so that no task has to order the whole group.
SLICES, STEP = 64, 8


def sliced(rows: DataFrame, by: str, *values: str) -> DataFrame:
    """rows with _slice_<value> for each of the values: approximate quantiles cut each group's values, equal ones into one slice. How good the cuts are changes the work of a task, never a rank."""
    marks = [i / SLICES for i in range(1, SLICES)]
    cuts = rows.groupBy(by).agg(*[F.percentile_approx(v, marks, 1000).alias(f"_cuts_{v}") for v in values])  # SLICES - 1 numbers a group
    out = rows.join(F.broadcast(cuts), by)
    below = lambda c, v: F.size(F.filter(c, lambda x: x < F.col(v)))
    for v in values:  # first among every STEPth cut, then among those between
        coarse = F.array(*[F.get(f"_cuts_{v}", F.lit(i)) for i in range(STEP - 1, SLICES - 1, STEP)])
        out = out.withColumn(f"_step_{v}", STEP * below(coarse, v))
        out = out.withColumn(f"_slice_{v}", F.col(f"_step_{v}") + below(F.slice(f"_cuts_{v}", F.col(f"_step_{v}") + 1, STEP - 1), v))
    return out.select(*rows.columns, *[f"_slice_{v}" for v in values])


def _sizes(cut: DataFrame, by: str, slice_: str) -> DataFrame:
    """by, the slice, _k (rows in it), _below (rows in the slices before), _all."""
    every = Window.partitionBy(by)
    sizes = cut.groupBy(by, slice_).agg(F.count("*").alias("_k"))
    return sizes.select(by, slice_, "_k", (F.sum("_k").over(every.orderBy(slice_)) - F.col("_k")).alias("_below"), F.sum("_k").over(every).alias("_all"))


def thresholds(rows: DataFrame, long: float = 0.7, short: float = 0.3, by: str = "config") -> DataFrame:
    """Exact quantiles (linear interpolation) of s. Only the slices that hold them are ordered. rows are gone through three times: from held() calls, if they are costly."""
    cut = sliced(rows.select(by, "s"), by, "s").withColumnRenamed("_slice_s", "_slice")
    sizes = _sizes(cut, by, "_slice")
    at = lambda p: (F.col("_all") - 1) * F.lit(p)
    wanted = [F.struct(F.lit(name).alias("name"), rank(at(p)).alias("rank"), weight(at(p)).alias("weight")) for name, p in (("long", long), ("short", short)) for rank, weight in ((F.floor, lambda x: 1 - x + F.floor(x)), (lambda x: F.floor(x) + 1, lambda x: x - F.floor(x)))]
    places = sizes.select(by, "_slice", "_below", "_k", F.explode(F.array(*wanted)).alias("w")).where("w.weight > 0 and w.rank >= _below and w.rank < _below + _k")
    asked = places.groupBy(by, "_slice").agg(F.collect_list(F.struct((F.col("w.rank") - F.col("_below") + 1).alias("n"), "w.name", "w.weight")).alias("_asked"))  # four at most
    few = cut.join(F.broadcast(asked), [by, "_slice"]).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_slice").orderBy("s")))
    hit = few.select(by, "s", F.explode(F.filter("_asked", lambda w: w["n"] == F.col("_n"))).alias("w"))
    part = lambda name: F.sum(F.when(F.col("w.name") == name, F.col("s") * F.col("w.weight")))
    return hit.groupBy(by).agg(part("long").alias("q_long"), part("short").alias("q_short"))


def average_ranks(rows: DataFrame, by: str, names: dict[str, str]) -> DataFrame:
    """rows with ranks (names: value -> name of its rank) of values in their group, from 1; equal values share the mean of their ranks."""
    cut = ranked = sliced(rows, by, *names)
    for value, name in names.items():
        slice_ = f"_slice_{value}"
        inside = Window.partitionBy(by, slice_)
        rank = F.rank().over(inside.orderBy(value)) + (F.count("*").over(Window.partitionBy(by, slice_, value)) - 1) / 2
        ranked = ranked.withColumn("_rank", rank).join(F.broadcast(_sizes(cut, by, slice_).select(by, slice_, "_below")), [by, slice_])
        ranked = ranked.withColumn(name, F.col("_rank") + F.col("_below")).drop("_rank", "_below")
    return ranked.select(*rows.columns, *names.values())


def positions(rows: DataFrame, cuts: DataFrame, by: str = "config") -> DataFrame:
    """rows with position (1 from the upper threshold, -1 up to the lower one, which wins ties), trade_return, active (against holding the share)."""
    df = rows.join(F.broadcast(cuts), by)
    df = df.withColumn("position", F.when(F.col("s") <= F.col("q_short"), -1).when(F.col("s") >= F.col("q_long"), 1).otherwise(0))
    return df.withColumn("trade_return", F.col("position") * F.col("r")).withColumn("active", F.col("trade_return") - F.col("r"))


def _ratio(x: str, days: Column) -> Column:
    """Mean over standard deviation, annualised; 0 where that isn't defined."""
    sd = F.stddev_samp(x)
    return F.coalesce(F.avg(x) / F.when(sd > 1e-15, sd) * F.sqrt(F.lit(252.0) / days), F.lit(0.0))


def metrics(trades: DataFrame, *by: str) -> DataFrame:
    """Figures by the given columns. trades: positions()."""
    days = F.first(holding_days(F.col("holding_period")))
    return trades.where("position <> 0").groupBy(*by).agg(
        F.count("*").alias("total_trades"),
        F.count_if(F.col("position") == 1).alias("long_trades"),
        F.count_if(F.col("position") == -1).alias("short_trades"),
        F.avg((F.col("trade_return") > 0).cast("double")).alias("win_rate"),
        F.avg((F.col("trade_return") <= 0).cast("double")).alias("false_positive_rate"),
        F.avg("trade_return").alias("mean_trade_return"),
        (F.product(1 + F.col("trade_return")) - 1).alias("cumulative_return"),
        _ratio("trade_return", days).alias("annualized_sharpe_ratio"),
        _ratio("active", days).alias("information_ratio"),
    )


NAMES = ("config", "signal_column", "holding_period", "actual_signal_used")


def grid(data: DataFrame, signals: tuple[str, ...] = L.SIGNALS, horizons: tuple[str, ...] = RETURNS) -> DataFrame:
    """Figures of every signal, horizon and direction. In-sample: thresholds come from the rows that are traded."""
    rows = configurations(held(data, *signals, *horizons), signals, horizons)
    return metrics(positions(rows, thresholds(rows)), *NAMES)


def single(data: DataFrame, signal: str = "confidence_score", horizon: str = "ret_5d") -> DataFrame:
    rows = configurations(held(data, signal, horizon), (signal,), (horizon,), (False,))
    return metrics(positions(rows, thresholds(rows)), *NAMES)


def best(results: DataFrame) -> DataFrame:
    """The row with the highest Sharpe ratio; of equals, the first in the grid."""
    return results.orderBy(F.desc("annualized_sharpe_ratio"), "config").limit(1)


def equity_curve(trades: DataFrame) -> DataFrame:
    """config, call_date, ticker, equity (product of 1 + trade returns so far), drawdown (against the highest so far).

    Days are ordered one by one: what the days before give (a product, a maximum) is a row a day.
    """
    day = ["config", "call_date"]
    before = Window.partitionBy("config").orderBy("call_date").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*day).orderBy("ticker").rowsBetween(Window.unboundedPreceding, 0)
    taken = trades.where("position <> 0").select(*day, "ticker", "trade_return", F.product(1 + F.col("trade_return")).over(within).alias("growth"))
    taken = shared.written(taken.withColumn("top", F.max("growth").over(within)), "trades")
    days = taken.groupBy(*day).agg(F.max("top").alias("day_top"), F.product(1 + F.col("trade_return")).alias("day_growth"))
    days = days.withColumn("start", F.coalesce(F.product("day_growth").over(before), F.lit(1.0)))
    days = days.withColumn("high", F.greatest(F.lit(1.0), F.coalesce(F.max(F.col("start") * F.col("day_top")).over(before), F.lit(1.0))))
    out = taken.join(F.broadcast(days.select(*day, "start", "high")), day).withColumn("equity", F.col("start") * F.col("growth"))
    return out.select(*day, "ticker", "equity", (F.col("equity") / F.greatest("high", F.col("start") * F.col("top")) - 1).alias("drawdown"))


def max_drawdown(trades: DataFrame) -> DataFrame:
    return equity_curve(trades).groupBy("config").agg(F.min("drawdown").alias("max_drawdown"))


def pearson(data: DataFrame, signals: tuple[str, ...] = L.SIGNALS, horizons: tuple[str, ...] = RETURNS) -> DataFrame:
    """signal_column, holding_period, n, r and its t statistic."""
    rows = configurations(data, signals, horizons, (False,))
    agg = rows.groupBy("signal_column", "holding_period").agg(F.count("*").alias("n"), F.corr("s", "r").alias("r"))
    agg = agg.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))
    return agg.withColumn("t", F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r"))))


def p_values(correlations: DataFrame) -> DataFrame:
    """pearson() with the two-sided p-value of t, from the incomplete beta function (a continued fraction, few rows)."""
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(float(a), int(b) - 2) if pd.notna(a) and b > 2 else None for a, b in zip(t, n, strict=True)])

    return correlations.withColumn("p_value", p("t", "n"))


def student_p(t: float, df: int) -> float:
    """Two-sided tail of Student's distribution."""
    from math import exp, lgamma, log

    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def ic_by_quarter(data: DataFrame, signal: str = "confidence_score", horizon: str = "ret_5d") -> DataFrame:
    """quarter, n, ic (Pearson) and rank_ic (of average ranks, that is Spearman) in each calendar quarter."""
    rows = data.select(F.date_trunc("quarter", F.col("trade_date")).cast("date").alias("quarter"), F.col(signal).cast("double").alias("s"), F.col(horizon).alias("r")).where("s is not null and r is not null")
    ranked = average_ranks(shared.written(rows, "returns"), "quarter", {"s": "rs", "r": "rr"})
    none = F.lit(None).cast("double")
    return ranked.groupBy("quarter").agg(F.count("*").alias("n"), F.nanvl(F.corr("s", "r"), none).alias("ic"), F.nanvl(F.corr("rs", "rr"), none).alias("rank_ic"))


def quintile_returns(data: DataFrame, signal: str = "confidence_score", n: int = 5) -> DataFrame:
    """bucket, n_calls, mean of each return, by signal quantile (ties in the signal by ticker and date)."""
    rows = held(data.where(F.col(signal).isNotNull()).withColumn("s", F.col(signal).cast("double")), "s", *RETURNS)
    return ntile(rows, n).groupBy("bucket").agg(F.count("*").alias("n_calls"), *[F.avg(h).alias(f"mean_{h}") for h in RETURNS])


def ntile(rows: DataFrame, n: int, slices: int = 64) -> DataFrame:
    """rows with bucket 1..n by (s, ticker, call_date), as ntile() over all rows, but without a sort in one task.

    Approximate quantiles cut the rows into slices of s; a row's rank is its place in its slice plus the sizes of the
    slices below. How good the cuts are changes the work of a task, never a rank.
    """
    marks = [i / slices for i in range(1, slices)]
    cuts = sorted(set(rows.agg(F.percentile_approx("s", marks, 1000)).first()[0] or []))  # slices - 1 numbers
    slice_ = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("s"))) if cuts else F.lit(0)
    cut = rows.withColumn("slice", slice_)
    sizes = cut.groupBy("slice").agg(F.count("*").alias("k"))  # a row a slice
    below = sizes.select("slice", F.sum("k").over(Window.orderBy("slice")).alias("upto"), "k", F.sum("k").over(Window.partitionBy()).alias("total"))
    ranked = cut.withColumn("at", F.row_number().over(Window.partitionBy("slice").orderBy("s", "ticker", "call_date")) - 1)
    ranked = ranked.join(F.broadcast(below), "slice").withColumn("rn", F.col("upto") - F.col("k") + F.col("at"))  # slices rows
    small, extra = F.floor(F.col("total") / n), F.col("total") % n
    large = (small + 1) * extra
    bucket = F.when(F.col("rn") < large, F.floor(F.col("rn") / (small + 1))).otherwise(extra + F.floor(F.try_divide(F.col("rn") - large, small))) + 1
    return ranked.withColumn("bucket", bucket).select(*rows.columns, "bucket")


def sharpe_rollup(trades: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sharpe ratio and trades by signal, horizon, sector and year, with subtotals (null: all). sectors: ticker, sector.
    A subtotal over several horizons is annualised by the mean holding time of its trades."""
    t = trades.where("position <> 0").join(sectors.hint("merge"), "ticker")  # neither side is small: a broadcast of the trades wouldn't fit the driver
    t = t.withColumn("year", F.substring("call_date", 1, 4)).withColumn("days", holding_days(F.col("holding_period")))
    by = ("actual_signal_used", "holding_period", "sector", "year")
    return t.rollup(*by).agg(F.count("*").alias("n_trades"), _ratio("trade_return", F.avg("days")).alias("sharpe"))


def out_of_sample(data: DataFrame, train_to: str, signals: tuple[str, ...] = L.SIGNALS, horizons: tuple[str, ...] = RETURNS) -> DataFrame:
    """The grid with thresholds from calls up to train_to (YYYYMMDD), traded on later calls only."""
    rows = configurations(held(data, *signals, *horizons), signals, horizons)
    cuts = thresholds(rows.where(F.col("call_date") <= train_to))
    return metrics(positions(rows.where(F.col("call_date") > train_to), cuts), *NAMES)


def walk_forward(data: DataFrame, cuts: list[str], signals: tuple[str, ...] = L.SIGNALS, horizons: tuple[str, ...] = RETURNS, last: str = "99999999") -> DataFrame:
    """A row for each fold: its configuration, chosen by the Sharpe ratio of the training span, and the figures of the span after it.

    cuts: dates (YYYYMMDD), ascending. Fold k learns from all calls up to cuts[k], thresholds and choice alike, and is reported on later ones up to cuts[k + 1] (the last fold: up to last).
    All folds are one job: a call is a row of every fold that learns from it or is reported on it. Of equal ratios the first configuration in the grid is chosen. A fold whose
    configuration doesn't trade in its span has null figures, one without training trades has no row.
    """
    if list(cuts) != sorted(set(cuts)):
        raise ValueError("cuts have to ascend")
    spans = list(zip(cuts, [*cuts[1:], last], strict=True))
    rows = configurations(held(data, *signals, *horizons), signals, horizons)
    role = lambda k, a, b: F.when(F.col("call_date") <= b, F.struct(F.lit(k).alias("fold"), (F.col("call_date") <= a).alias("learns")))
    every = rows.withColumn("f", F.explode(F.array_compact(F.array(*[role(k, a, b) for k, (a, b) in enumerate(spans)])))).select("*", "f.*").drop("f")
    every = every.withColumn("cell", F.col("fold") * (2 * len(signals) * len(horizons)) + F.col("config"))
    traded = positions(every, thresholds(every.where("learns"), by="cell"), by="cell")
    figures = metrics(traded, "fold", "learns", *NAMES)
    best_of = F.max_by(F.struct("config", F.col("annualized_sharpe_ratio").alias("train_sharpe")), F.struct("annualized_sharpe_ratio", -F.col("config")))
    chosen = figures.where("learns").groupBy("fold").agg(best_of.alias("b")).select("fold", "b.*")
    names = figures.select(*NAMES).distinct()  # a row for each configuration
    dates = data.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "fold int, train_to string, test_to string")
    later = figures.where("not learns").drop("learns", *NAMES[1:])
    return dates.join(chosen, "fold").join(names, "config").join(later, ["fold", "config"], "left")


def ablation(data: DataFrame, variants: dict[str, Column], horizon: str = "ret_5d") -> DataFrame:
    """Figures of alternative signals (name -> expression) under one horizon."""
    names = tuple(variants)
    wide = held(data.select("ticker", "call_date", horizon, *[c.alias(k) for k, c in variants.items()]), horizon, *names)
    rows = configurations(wide, names, (horizon,), (False,))
    return metrics(positions(rows, thresholds(rows)), *NAMES)


def results_json(results: DataFrame) -> DataFrame:
    """One row, json: {optimal_primary_strategy, ablation_tests}; the grid has as many rows as configurations."""
    one = F.struct(*results.columns)
    return results.agg(F.to_json(F.struct(F.max_by(one, F.struct("annualized_sharpe_ratio", -F.col("config"))).alias("optimal_primary_strategy"), F.array_sort(F.collect_list(one)).alias("ablation_tests"))).alias("json"))
