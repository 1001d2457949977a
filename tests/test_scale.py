"""What plans and sinks do with tables whose size Spark can't tell, or that have many keys."""

import datetime as dt
import json

import pytest

from tonefold import shared
from tonefold.llm import bpe
from tonefold.operators import returns as R
from tonefold.queries import QUERIES
from tonefold.sources import readers, sinks


def nodes(df):
    """Depth and text of each node of the plan as it was before it ran."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    lines = [x for x in text.split("== Initial Plan ==")[-1].splitlines() if x.strip(" :+-")]
    return [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-")) for x in lines]


def unpivoted_and_broadcast(df):
    """Generate nodes under a broadcast with no aggregate between: rows by configuration, sent whole to the driver."""
    found, above = [], []
    for depth, node in nodes(df):
        above = [(d, n) for d, n in above if d < depth]
        inside = [n for _, n in above]
        last = max((i for i, n in enumerate(inside) if n.startswith("BroadcastExchange")), default=None)
        if node.startswith("Generate") and last is not None and not any("Aggregate" in n for n in inside[last:]):
            found.append(node[:80])
        above.append((depth, node))
    return found


@pytest.mark.parametrize("name", ["backtest_grid", "sharpe_rollup", "equity_curve", "backtest_best", "walk_forward", "key_figures", "max_drawdown", "quantile_positions", "result_files"])
def test_rows_by_configuration_are_not_broadcast(spark, sf_dir, name, monkeypatch):
    plans, written = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, to: plans.append(df) or written(df, to))
    monkeypatch.setattr("tonefold.sources.sinks.write_results", lambda df, path, f=__import__("tonefold.sources.sinks", fromlist=["x"]).write_results: plans.append(df) or f(df, path))
    plans.append(QUERIES[name](spark, sf_dir))
    assert any(n.startswith("Generate") for df in plans for _, n in nodes(df))
    assert [x for df in plans for x in unpivoted_and_broadcast(df)] == []


@pytest.mark.parametrize("name", ["equity_curve", "max_drawdown"])
def test_trades_and_days_meet_by_named_side(spark, sf_dir, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # estimates decide nothing: for max_drawdown those of both sides are equal
    try:
        plan = [n for _, n in nodes(QUERIES[name](spark, sf_dir))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joins = [n for n in plan if "Join" in n.split("[")[0]]
    assert len(joins) == 1 and joins[0].startswith("BroadcastHashJoin") and "BuildRight" in joins[0]


def test_asof_windows_are_not_gone_through_anew_for_each_row(spark, sf_dir):
    for name in ("asof_hourly", "asof_entry"):
        frames = [n for _, n in nodes(QUERIES[name](spark, sf_dir)) if n.startswith("Window")]
        assert frames and not [n[:200] for n in frames if "unboundedfollowing" in n.lower()], name


def test_backwards_asof_keeps_ties_and_nulls(spark):
    day = lambda k: k and dt.date(2024, 1, k)
    bars = spark.createDataFrame([("A", day(k), float(k), float(k)) for k in (2, 3, 5, 9)] + [("B", day(4), 4.0, 4.0)], "ticker string, date date, open double, close double")
    calls = spark.createDataFrame([("A", day(k)) for k in (1, 2, 4, 5, 5, 9, 10, None)] + [("B", day(4)), ("B", day(5)), ("C", day(1))], "ticker string, call_date date")
    want = {("A", 1): 2, ("A", 2): 2, ("A", 4): 5, ("A", 5): 5, ("A", 9): 9, ("A", 0): 2, ("B", 4): 4}
    found = R.entries(calls, bars).collect()
    assert {(r.ticker, r.call_date.day if r.call_date else 0): r.entry_date.day for r in found} == want and len(found) == len(want) + 1  # two equal calls
    for width in (86_400, 3 * 86_400, 64 * 86_400):
        slotted = R.bucketed_entries(calls.where("call_date is not null"), bars, width=width, block=5).collect()
        assert {(r.ticker, r.call_date.day): r.entry_date.day for r in slotted} == {k: v for k, v in want.items() if k[1]}


def test_prices_of_many_tickers_are_few_files(spark, tmp_path):
    path, columns = str(tmp_path / "prices"), "ticker string, date date, open double, high double, low double, close double, volume long"
    rows = lambda tickers, close: [(t, dt.date(2024, 1, d), 1.0, 2.0, 0.5, close, 9) for t in tickers for d in (2, 3)]
    tickers = [*[f"T{k}" for k in range(400)], "", "007", "A/B", None]
    read = lambda: sorted(map(tuple, readers.prices(spark, path).collect()), key=repr)
    sinks.write_prices(spark.createDataFrame(rows(tickers, 1.0), columns), path)
    assert read() == sorted(rows(tickers, 1.0), key=repr)
    assert len(list(tmp_path.rglob("*.parquet"))) <= sinks.PRICE_PARTS * sinks.PART_FILES
    assert len(list((tmp_path / "prices").glob("*=*"))) <= sinks.PRICE_PARTS
    again = ["T7", "T999", "", None]
    sinks.write_prices(spark.createDataFrame(rows(again, 2.0), columns), path)  # replaces its own tickers only
    assert read() == sorted(rows([t for t in tickers if t not in again], 1.0) + rows(again, 2.0), key=repr)


def test_an_encoder_forgets_words(tmp_path):
    alphabet = bpe.byte_alphabet()
    vocab = {c: i for i, c in enumerate(alphabet)}
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": vocab | {"ab": 300}, "merges": ["a b"]}}))
    enc, small = bpe.Encoder(str(tmp_path / "t.json")), bpe.Encoder(str(tmp_path / "t.json"), words=8)
    text = " ".join(f"ab{k}" for k in range(400_000))
    found = enc.encode(text)
    assert len(enc.later) + len(getattr(enc.later, "old", ())) <= 300_000  # the rest of a Python process's memory is for other stages
    assert small.encode(text[:5000] + " ab1 ab2 ab1") == enc.encode(text[:5000] + " ab1 ab2 ab1") and enc.decode(found).decode() == text
