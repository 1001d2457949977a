"""Sources, sinks, service and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tonefold import lexicon as L
from tonefold.functions import lexical as X
from tonefold.operators import diarize as D
from tonefold.operators import returns as R
from tonefold.operators import signals as S
from tonefold.plans import service
from tonefold.sources import paged, paged_stream, readers, sinks, synthetic
from tonefold.streaming import ingest


def test_json_transcripts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ticker": "A", "date": "20240101", "raw_text": "x\ny", "source": "s"}, indent=2))
    (tmp_path / "b.json").write_text("{broken")
    raw = readers.raw_transcripts(spark, str(tmp_path))
    assert raw.where("ticker = 'A'").first().raw_text == "x\ny"
    assert readers.bad_files(raw.cache()).first().bad_files == 1


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Word,Negative,Positive,Uncertainty,Strong_Modal\nLOSS,2009,0,0,0\nGAIN,0,2009,0,0\nMAY,0,0,-2011,0\nX1,2009,0,0,0\nMUST,0,0,,1\n")
    got = {(r.category, r.word) for r in readers.dictionary(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {("negative", "loss"), ("positive", "gain"), ("uncertainty", "may"), ("strong_modal", "must")}
    assert ("uncertainty", "may") not in {(r.category, r.word) for r in readers.dictionary(spark, str(tmp_path / "d.csv"), True).collect()}
    assert readers.as_lexicon(readers.dictionary(spark, str(tmp_path / "d.csv"))) is L.FINANCE


def test_normalized(spark):
    rows = spark.createDataFrame([(0, "abc ", "t" * 200, "2024-01-02"), (1, "", "short", None), (2, None, "u" * 300, "x")], "i int, symbol string, content string, date string")
    got = readers.normalized(rows, F.col("i")).orderBy("dataset_row_id").collect()
    assert [(r.ticker, r.date) for r in got] == [("ABC", "20240102"), ("UNKNOWN_0002", "19000101")]


def test_synthetic_to_signals_and_sinks(spark, tmp_path):
    raw = synthetic.transcripts(spark, 50)
    assert raw.count() == 50 and raw.select("ticker").distinct().count() > 10
    sents = D.preprocess(raw.dropDuplicates(["ticker", "date"]))
    sig = S.transcript_signals(S.scored(sents))
    rows = sig.collect()
    assert rows and all(-1 <= r.confidence_score <= 1 and r.hedge_density >= 0 for r in rows)
    sinks.write_sentences(sents, str(tmp_path / "sents"))
    assert spark.read.parquet(str(tmp_path / "sents")).count() == sents.count()
    sinks.write_raw(raw, str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == raw.select("ticker", "date").distinct().count()
    sinks.write_signals(sig.drop("has_qa", "certainty", "specificity"), str(tmp_path / "sig"))
    assert readers.signals(spark, str(tmp_path / "sig")).count() == len(rows)


def test_prices_fallback(spark):
    a = spark.createDataFrame([("A", 1)], "ticker string, p int")
    b = spark.createDataFrame([("A", 2), ("B", 3)], "ticker string, p int")
    assert sorted(r.p for r in readers.with_fallback(a, b).collect()) == [1, 3]


def test_paged_source(spark):
    def fetch(offset, size):
        return [(f"T{i}", "20240101", "x" * (2000 if i % 2 else 10), "archive") for i in range(offset, offset + size)]

    got = paged.read_pages(spark, fetch, 25, per_second=1000.0)
    assert [r.ticker for r in got.collect()] == [f"T{i}" for i in range(1, 50, 2)]  # on and on, until 25 are kept
    ends = paged.read_pages(spark, lambda at, size: fetch(at, size) if at < 30 else [], 25, per_second=1000.0)
    assert ends.count() == 15


def test_lexicon_is_stored(spark, tmp_path):
    path, made = str(tmp_path / "lexicon"), []

    def make():
        made.append(1)
        return spark.createDataFrame([("positive", f"w{i}") for i in range(150)], "category string, word string")

    assert readers.stored_lexicon(spark, path) is L.FINANCE
    first = readers.stored_lexicon(spark, path, make)
    assert len(first["positive"]) == 150 and readers.stored_lexicon(spark, path, make) == first and made == [1]


def test_sentence_files(spark, tmp_path):
    rows = [{"sentence_id": 0, "ticker": "A", "date": "20240101", "speaker_role": "ceo", "speaker_name": "Ann", "section": "qa", "text": "x y z", "word_count": 3}]
    (tmp_path / "A_20240101.json").write_text(json.dumps(rows, indent=2))
    got = readers.sentences(spark, str(tmp_path))
    assert [r.asDict() for r in got.select(*rows[0]).collect()] == rows


def test_prices_and_returns_round_trip(spark, tmp_path):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, d), 1.0, 2.0, 0.5, float(d), 9) for d in range(1, 9)], "ticker string, date date, open double, high double, low double, close double, volume long")
    sinks.write_prices(bars, str(tmp_path / "p"))
    assert sorted(map(tuple, readers.prices(spark, str(tmp_path / "p")).select(*bars.columns).collect())) == sorted(map(tuple, bars.collect()))
    index = R.returns_index(spark.createDataFrame([("A", dt.date(2024, 1, 2))], "ticker string, call_date date"), bars)
    sinks.write_returns(index, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).collect() == index.collect()


def test_matcher_is_stored(spark, tmp_path):
    path = str(tmp_path / "matcher")
    sinks.write_matcher(spark, path)
    pattern = readers.matcher(spark, path)
    assert pattern == X.span_pattern()
    df = spark.createDataFrame([("We believe this might be subject to change.",)], "text string")
    got = df.select(X.hedge_spans(F.col("text"), pattern=pattern).alias("s")).first().s
    assert got == df.select(X.hedge_spans(F.col("text")).alias("s")).first().s != []


def test_a_model_labels_sentences(spark):
    sents = spark.createDataFrame([("A", "good loss"), ("B", "bad gain")], "ticker string, text string")

    def model(batches):
        for texts in batches:
            yield texts.str.startswith("bad").astype("int32")

    assert {r.ticker: (r.label, r.score) for r in S.scored(sents, model=model).collect()} == {"A": (0, 1), "B": (1, -1)}


def test_api_key():
    assert service.authorized("k1", "k1") and not service.authorized("k2", "k1")
    assert not service.authorized(None, "k1") and not service.authorized("", "")


def test_service(spark):
    text = "We expect growth of approximately 5 percent next quarter. We must deliver record results, and we will be strong."
    row = service.analyze(spark, text).first()
    assert row.sentences_parsed == 2 and row.total_words == 19 and row.hedge_density > 0
    with pytest.raises(ValueError, match="50"):
        service.analyze(spark, "short")
    sig = spark.createDataFrame([("Abc", "20240101", 0.5)], "ticker string, call_date string, confidence_score double")
    assert service.signals_of(sig, "aBC").count() == 1
    with pytest.raises(service.NotFound):
        service.signals_of(sig, "zzz")
    assert service.health(spark, sig)["status"] == "ok"


def test_a_table_of_requests(spark):
    text = "We expect growth of approximately 5 percent next quarter. We must deliver record results, and we will be strong."
    rows = [(1, text), (2, "short"), (3, None), (4, "x" * 60), (5, text), (6, "")]
    got = {r.id: r for r in service.analyze_all(spark.createDataFrame(rows, "id long, text string")).collect()}
    one = service.analyze(spark, text).first()
    assert all(got[k][c] == one[c] for k in (1, 5) for c in ("remarks_sentiment", "confidence_score", "hedge_density", "total_words", "sentences_parsed"))
    assert [(got[k].status, got[k].sentences_parsed, got[k].confidence_score) for k in (2, 3, 4, 6)] == [("too_short", 0, None), ("too_short", 0, None), ("ok", 0, None), ("too_short", 0, None)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, t in enumerate(("A", "B", "A")):
        (src / f"{i}.json").write_text(json.dumps({"ticker": t, "date": "20240101", "raw_text": "loss and growth", "source": "s"}))
    got = []
    q = ingest.run_batches(ingest.scored_stream(ingest.transcript_stream(spark, str(src))), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r.ticker for r in got) == ["A", "B"]
    assert all(r.negative > 0 for r in got)
    ticks = spark.createDataFrame([("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-01-01 10:10:00", 3.0), ("A", "2024-01-01 12:00:00", 2.0)], "ticker string, ts string, price double").withColumn("ts", F.to_timestamp("ts"))
    assert ingest.sessions(ticks).count() == 2
    bar = ingest.bar_stream(ticks).first()
    assert (bar.open, bar.high, bar.close, bar.volume) == (1.0, 3.0, 2.0, 3)


def test_a_file_a_key_as_a_transaction(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [("A B", "20240101", "é " * 800, "s", 2), ("AB", "20240101", "second", "s", 3), ("C", None, "short", "s", 4), (None, "20240102", "x" * 2000, "s", 5)]
    df = spark.createDataFrame(rows, "ticker string, date string, raw_text string, source string, dataset_row_id long")
    sinks.write_raw_files(df.repartition(3), path)
    files = {p.name: p for p in (tmp_path / "raw").iterdir()}
    assert sorted(files) == ["AB_20240101.json", "C_19000101.json", "UNKNOWN_20240102.json"]
    assert json.loads(files["AB_20240101.json"].read_text())["dataset_row_id"] == 2
    stamps = {n: p.stat().st_mtime_ns for n, p in files.items()}
    sinks.write_raw_files(df, path)  # again: only the small file is replaced
    assert {p.name for p in (tmp_path / "raw").iterdir() if p.stat().st_mtime_ns != stamps[p.name]} == {"C_19000101.json"}
    back = readers.raw_transcripts(spark, path)
    assert {r.ticker: r.raw_text for r in back.collect()} == {"AB": "é " * 800, "C": "short", "UNKNOWN": "x" * 2000}


def test_a_job_that_fails_leaves_no_key(spark, tmp_path):
    path = str(tmp_path / "raw")

    def rows(fails):
        no = F.col("id")
        row_id = F.when(no == 150, F.raise_error(F.lit("lost")).cast("long")).otherwise(no) if fails else no
        return spark.range(0, 200, 1, 4).select(F.format_string("T%d", no).alias("ticker"), F.lit("20240101").alias("date"), F.lit("x" * 1500).alias("raw_text"), row_id.alias("dataset_row_id"))

    keys = lambda: [p.name for p in (tmp_path / "raw").iterdir() if not p.name.startswith("_")]
    with pytest.raises(Exception, match="lost"):
        sinks.keyed.write(rows(True), path)
    assert keys() == []
    sinks.keyed.write(rows(False), path)
    assert len(keys()) == 200


def test_a_paged_stream_reads_each_record_once(spark, tmp_path):
    store, asked = tmp_path / "store.jsonl", tmp_path / "asked"

    def fetch(at, size):
        with asked.open("a") as f:
            f.write(f"{at} {size}\n")
        return [tuple(json.loads(x)) for x in store.read_text().splitlines()[at : at + size]]

    def add(a, b):
        with store.open("a") as f:
            f.writelines(json.dumps([f"T{i}", "20240101", "x" * (5 if i % 4 == 1 else 30), "s"]) + "\n" for i in range(a, b))

    def run(batches):
        query = paged_stream.stream_pages(spark, fetch, page=5, per_second=1000, least_chars=10, pages=3).writeStream.foreachBatch(lambda df, n: batches.append((n, sorted(r.dataset_row_id for r in df.collect())))).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    add(0, 37)
    first, second, third = [], [], []
    run(first)
    kept = lambda a, b: [i for i in range(a, b) if i % 4 != 1]
    assert [i for _, rows in first for i in rows] == kept(0, 37) and len(first) >= 3  # 15 records a batch
    run(second)
    assert [i for _, rows in second for i in rows] == []
    add(37, 60)
    run(third)
    assert [i for _, rows in third for i in rows] == kept(37, 60)
    assert max(int(x.split()[1]) for x in asked.read_text().splitlines()) <= 5
