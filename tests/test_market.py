"""Returns, backtests and statistics against hand-computed or pandas results."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonefold.operators import backtest as B
from tonefold.operators import returns as R
from tonefold.operators import stats as St

D = dt.date


def bars(spark, rows):
    return spark.createDataFrame([("A", d, c, c, c, c, 1) for d, c in rows], "ticker string, date date, open double, high double, low double, close double, volume long")


def test_forward_returns(spark):
    days = [D(2024, 1, k) for k in (2, 3, 4, 8, 9, 10)]
    b = bars(spark, list(zip(days, [10.0, 11.0, 0.0, 12.0, 15.0, 18.0], strict=True)))
    calls = spark.createDataFrame([("A", d) for d in (D(2024, 1, 1), D(2024, 1, 4), D(2024, 1, 6), D(2024, 1, 10), D(2024, 1, 11))] + [("B", D(2024, 1, 2))], "ticker string, call_date date")
    got = {r.call_date: (r.ret_1d, r.ret_3d, r.ret_5d) for r in R.returns_index(calls, b).collect()}
    assert got["20240101"] == pytest.approx((0.1, 0.2, 0.8))
    assert got["20240104"] == (None, None, None)  # a price of zero
    assert got["20240106"] == (pytest.approx(0.25), None, None)  # a weekend: the next bar
    assert got["20240110"] == (None, None, None)  # the last bar
    assert len(got) == 4  # after the last bar, and a ticker without bars: no row


def test_bucketed_entries(spark):
    rnd = random.Random(11)
    first = D(2020, 1, 1)
    day = lambda k: first + dt.timedelta(days=k)
    rows = [("HOT", day(k), float(rnd.randint(0, 40))) for k in sorted(rnd.sample(range(6000), 3600))]
    rows += [(t, day(k), float(rnd.randint(1, 9))) for t in "ABCD" for k in sorted(rnd.sample(range(1500), 100))]
    b = spark.createDataFrame([(t, d, c + 1, c, c, c, 1) for t, d, c in rows], "ticker string, date date, open double, high double, low double, close double, volume long")
    calls = spark.createDataFrame([(rnd.choice(["HOT", "HOT", "A", "B", "C", "D", "NONE"]), day(rnd.randrange(-50, 6100))) for _ in range(800)], "ticker string, call_date date")
    for entry in ("close", "open"):
        want = sorted((tuple(r) for r in R.entries(calls, b, entry=entry).collect()), key=repr)
        assert len(want) > 300
        for width, block in ((64 * 86_400, 4096), (5 * 86_400, 7), (10**10, 5)):
            assert sorted((tuple(r) for r in R.bucketed_entries(calls, b, entry=entry, width=width, block=block).collect()), key=repr) == want
    sizes = sorted(r["count"] for r in b.groupBy("ticker", F.floor(F.unix_seconds(F.col("date").cast("timestamp")) / (64 * 86_400))).count().collect() if r.ticker == "HOT")
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]  # the ticker with nine tenths of all bars is dealt out evenly
    with pytest.raises(ValueError):
        R.bucketed_entries(calls, b, block=3)
    assert R.bucketed_entries(calls, b.where("false")).count() == 0 == R.bucketed_entries(calls.where("false"), b).count()


def data(spark, n=200, seed=1):
    rnd = random.Random(seed)
    rows = [(f"T{i % 7}", f"2024{1 + i % 12:02d}{1 + i % 28:02d}", round(rnd.gauss(0, 1), 2), rnd.gauss(0, 0.02), None if i % 9 == 0 else rnd.gauss(0, 0.03)) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, call_date string, s double, ret_1d double, ret_5d double")


def test_metrics_match_pandas(spark):
    df = data(spark)
    rows = B.configurations(df, ("s",), ("ret_5d",), (False,))
    got = B.metrics(B.positions(rows, B.thresholds(rows)), *B.NAMES).first()
    p = df.toPandas().dropna(subset=["s", "ret_5d"])
    hi, lo = p.s.quantile(0.7), p.s.quantile(0.3)
    pos = (p.s >= hi).astype(int).where(p.s > lo, -1)
    t = (pos * p.ret_5d)[pos != 0]
    assert got.total_trades == len(t) == got.long_trades + got.short_trades
    assert got.annualized_sharpe_ratio == pytest.approx(t.mean() / t.std() * (252 / 5) ** 0.5)
    assert got.cumulative_return == pytest.approx((1 + t).prod() - 1)
    assert got.win_rate == pytest.approx((t > 0).mean())


def test_constant_signal_is_all_short_and_nothing_is_floored(spark):
    df = spark.createDataFrame([("A", f"202401{k:02d}", 1.0, 0.01) for k in range(1, 11)], "ticker string, call_date string, s double, ret_1d double")
    rows = B.configurations(df, ("s",), ("ret_1d",), (False,))
    got = B.metrics(B.positions(rows, B.thresholds(rows)), *B.NAMES).first()
    assert (got.long_trades, got.short_trades, got.win_rate) == (0, 10, 0.0)
    assert got.annualized_sharpe_ratio == 0.0


def test_best_takes_the_first_of_equals(spark):
    r = spark.createDataFrame([(1, 0.5), (0, 0.5), (2, 0.1)], "config int, annualized_sharpe_ratio double")
    assert B.best(r).first().config == 0


def test_ntile_is_ntile(spark):
    df = data(spark, 103)
    got = {(r.ticker, r.call_date, r.s): r.bucket for r in B.ntile(df, 5).collect()}
    ordered = sorted(got)
    ordered.sort(key=lambda k: (k[2], k[0], k[1]))
    counts = pd.Series([got[k] for k in ordered])
    assert counts.is_monotonic_increasing
    assert sorted(B.ntile(df, 5).groupBy("bucket").count().toPandas()["count"]) == [20, 20, 21, 21, 21]


def test_student_p():
    assert B.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert B.student_p(0.5, 30) == pytest.approx(0.62072, abs=1e-4)


def test_keep_first_and_anti(spark):
    raw = spark.createDataFrame([("A", "1", "x", 2), ("A", "1", "y", 1), ("B", "1", None, 3)], "ticker string, date string, raw_text string, dataset_row_id long")
    assert sorted(r.dataset_row_id for r in St.keep_first(raw, ("dataset_row_id",)).collect()) == [1, 3]
    stored = spark.createDataFrame([("A", "1", 2000), ("B", "1", 10)], "ticker string, date string, size long")
    assert {r.ticker for r in St.not_yet_stored(raw, stored).collect()} == {"B"}


def test_first_source_and_unite(spark):
    a, b = spark.createDataFrame([], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert St.first_source(a, b).count() == 2
    assert [r.k for r in St.unite(spark.createDataFrame([(9,)], "k int"), b, 2, ("k",)).collect()] == [9, 1]


def test_split_is_stable_and_stratified(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("label"))
    a = {r.id: r.part for r in St.split(rows, F.col("id")).collect()}
    b = {r.id: r.part for r in St.split(rows.repartition(7), F.col("id")).collect()}
    assert a == b
    n = St.stratified_split(rows, F.col("id")).groupBy("label", "part").count().collect()
    assert {(r.label, r.part): r["count"] for r in n}[(0, "train")] == pytest.approx(350, abs=2)


def test_macro_f1(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, predicted int")
    got = St.macro_f1(rows).first()
    assert (got.n, got.accuracy) == (4, 0.5)
    assert got.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_span_recall(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "c", "d"])], "expected array<string>, found array<string>")
    got = St.span_recall(rows).first()
    assert (got.count_ratio, got.recall) == (1.5, 0.5)


def test_results_json(spark):
    import json

    r = spark.createDataFrame([(0, 0.1), (1, 0.9)], "config int, annualized_sharpe_ratio double")
    got = json.loads(B.results_json(r).first().json)
    assert got["optimal_primary_strategy"]["config"] == 1
    assert len(got["ablation_tests"]) == 2


def test_walk_forward_chooses_on_the_training_span(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(600):  # one signal foretells returns until June, the other from then on
        month, a, b = 1 + i % 12, rnd.gauss(0, 1), rnd.gauss(0, 1)
        rows.append((f"T{i}", f"2024{month:02d}{1 + i % 28:02d}", a, b, 0.01 * (a if month < 7 else b) + rnd.gauss(0, 0.002)))
    df = spark.createDataFrame(rows, "ticker string, call_date string, a double, b double, ret_1d double")
    got = {r.fold: r for r in B.walk_forward(df, ["20240331", "20240630", "20241130"], ("a", "b"), ("ret_1d",)).collect()}
    assert [got[k].actual_signal_used for k in range(3)] == ["a", "a", "a"] and [got[k].test_to for k in range(3)] == ["20240630", "20241130", "99999999"]
    assert got[0].annualized_sharpe_ratio > 5 > abs(got[1].annualized_sharpe_ratio)  # chosen before it stopped to work
    for k, (a, b) in enumerate((("20240331", "20240630"), ("20240630", "20241130"))):  # each fold by itself
        some = df.where(f"call_date <= '{b}'")
        train = {r.config: r.annualized_sharpe_ratio for r in B.grid(df.where(f"call_date <= '{a}'"), ("a", "b"), ("ret_1d",)).collect()}
        assert got[k].config == max(train, key=lambda c: (train[c], -c)) and got[k].train_sharpe == pytest.approx(max(train.values()))
        want = {r.config: r for r in B.out_of_sample(some, a, ("a", "b"), ("ret_1d",)).collect()}[got[k].config]
        assert got[k].annualized_sharpe_ratio == pytest.approx(want.annualized_sharpe_ratio) and got[k].total_trades == want.total_trades
    with pytest.raises(ValueError):
        B.walk_forward(df, ["20240630", "20240331"], ("a",), ("ret_1d",))


def test_sketches_keep_their_error_when_merged(spark):
    rnd = random.Random(6)
    rows = [("x", 1_700_000_000 + 60 * i, rnd.lognormvariate(0, 2)) for i in range(30_000)] + [("x", None, 1.0), ("x", 1_700_000_000, None), ("x", 1_700_000_000, float("nan")), ("y", 1_700_000_000, 5.0)]
    df = spark.createDataFrame(rows, "api string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    hours = St.latency_sketches(df, "v", "ts", "api")
    assert hours.where("api = 'x'").count() == 501 and hours.agg(F.sum("n")).first()[0] == 30_001
    for span in ("day", "year"):
        for r in St.latency_over(hours, span, "api").where("api = 'x'").collect():
            own = sorted(x.v for x in df.where(f"api = 'x' and v is not null and not isnan(v) and date_trunc('{span}', ts) = timestamp'{r.span}'").select("v").collect())
            assert r.n == len(own)
            for p, q in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
                low, high = sum(v < q for v in own) / len(own), sum(v <= q for v in own) / len(own)
                assert low - 2 * St.RANK_ERROR <= p <= high + 2 * St.RANK_ERROR
    one = St.latency_over(hours, "year", "api").where("api = 'y'").first()
    assert (one.n, one.p50, one.p99) == (1, 5.0, 5.0)
