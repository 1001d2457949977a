"""Collection statistics, de-duplication, sampling of labels, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonefold.functions import text as T


def collection_stats(raw: DataFrame, as_of: str, first: int = 20) -> DataFrame:
    """One row: files, lengths, counts by source family, tickers (the first ones, sorted), range of valid dates."""
    valid = F.when(T.is_valid_date(F.col("date"), as_of), F.col("date"))
    n = F.length("raw_text")
    families = raw.groupBy(T.source_family(F.col("source")).alias("family")).agg(F.count("*").alias("n"))
    by_family = families.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "n")))).alias("sources"))
    tickers = raw.select("ticker").distinct()
    named = tickers.orderBy("ticker").limit(first).agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))
    main = raw.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(n), F.lit(0)).alias("total_chars"), F.min(n).alias("min_text_len"), F.max(n).alias("max_text_len"), F.min(valid).alias("first_date"), F.max(valid).alias("last_date"), F.countDistinct("ticker").alias("unique_tickers"))
    return main.crossJoin(by_family).crossJoin(named)  # three single rows


def call_dates(raw: DataFrame) -> DataFrame:
    """ticker, n_dates, dates (each once, ascending)."""
    once = raw.select("ticker", "date").distinct()
    return once.groupBy("ticker").agg(F.count("date").alias("n_dates"), F.array_sort(F.collect_list("date")).alias("dates"))


def keep_first(raw: DataFrame, order: tuple[str, ...], key: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """The first row of each key. Aggregated before the shuffle, so a key with very many rows costs no task its memory."""
    rest = [c for c in raw.columns if c not in key]
    row = F.struct(*rest)
    return raw.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("row")).select(*key, "row.*").select(*raw.columns)


def not_yet_stored(raw: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("ticker", "date"), least_bytes: int = 1000) -> DataFrame:
    """Rows whose key has no stored file of more than least_bytes. stored: key, size."""
    return raw.join(stored.where(F.col("size") > least_bytes).select(*key).distinct(), list(key), "left_anti")


def first_source(*sources: DataFrame) -> DataFrame:
    """Rows of the first source that has any (sources in order of priority, of one schema): all are tagged, and the least tag wins."""
    tagged = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    least = every.agg(F.min("_rank").alias("_rank"))
    return every.join(F.broadcast(least), "_rank", "left_semi").drop("_rank")  # one row


def unite(first: DataFrame, second: DataFrame, limit: int, order: tuple[str, ...]) -> DataFrame:
    """All of first, then of second, up to limit rows in all."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("_o", *order).limit(limit).drop("_o")


def class_cap(labelled: DataFrame, total: int, order: tuple[str, ...], classes: int = 3) -> DataFrame:
    """The first total // classes rows of each label, in order."""
    w = Window.partitionBy("label").orderBy(*order)
    return labelled.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= total // classes).drop("_n")


def _hashed(key: Column, seed: int) -> Column:
    """Hexadecimal; any engine has this hash."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def split(rows: DataFrame, key: Column, seed: int = 42, train: int = 70, validate: int = 15) -> DataFrame:
    """rows with part (train, validation, test) by a hash of key: stable under repartitioning, and a repeat goes with its original."""
    bucket = F.conv(F.substring(_hashed(key, seed), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("part", F.when(bucket < train, "train").when(bucket < train + validate, "validation").otherwise("test"))


def stratified_split(rows: DataFrame, key: Column, seed: int = 42, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """As split(), with the same shares in each label: by rank of the hash within the label."""
    share = F.percent_rank().over(Window.partitionBy("label").orderBy(_hashed(key, seed)))
    return rows.withColumn("_s", share).withColumn("part", F.when(F.col("_s") < train, "train").when(F.col("_s") < train + validate, "validation").otherwise("test")).drop("_s")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1 (mean F1 over the labels that occur as truth or prediction)."""
    m = confusion(rows)
    cells = m.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("pred")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("pred")))).alias("x")).select("x.*")
    per = cells.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("truth").alias("truth"), F.sum("pred").alias("pred"))
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("truth") + F.col("pred"))
    return per.agg(F.sum("truth").alias("n"), F.try_divide(F.sum("tp").cast("double"), F.sum("truth")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def span_recall(rows: DataFrame) -> DataFrame:
    """rows: expected and found (arrays of spans). count_ratio (found over expected, which over-finding inflates) and recall (expected spans that are found)."""
    return rows.agg(F.try_divide(F.sum(F.size("found")).cast("double"), F.sum(F.size("expected"))).alias("count_ratio"), F.try_divide(F.sum(F.size(F.array_intersect("expected", "found"))).cast("double"), F.sum(F.size(F.array_distinct("expected")))).alias("recall"))


def latency_percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.percentile(value, p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])


#: Size parameter of the latency sketches, and the rank error that it stands for: a quantile of a sketch is, with 99 %, the exact quantile of a share at most so far off, whatever was merged.
SKETCH, RANK_ERROR = 400, 0.0075


def latency_sketches(rows: DataFrame, value: str, ts: str, *by: str) -> DataFrame:
    """by, hour, n and a mergeable quantile sketch of the values of each hour: a table to be stored. Null values and times are left out; values that aren't finite, too."""
    known = rows.select(*by, F.date_trunc("hour", F.col(ts)).alias("hour"), F.col(value).cast("double").alias("v")).where("hour is not null and v is not null and not isnan(v) and abs(v) < double('infinity')")
    return known.groupBy(*by, "hour").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("sketch"))


def latency_over(sketches: DataFrame, span: str, *by: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """by, span (start of the day, week or any unit of date_trunc), n and quantiles p50, ... of all hours of the span, from stored sketches alone."""
    merged = sketches.groupBy(*by, F.date_trunc(span, F.col("hour")).alias("span")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    return merged.select(*by, "span", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{int(p * 100)}") for p in shares])
