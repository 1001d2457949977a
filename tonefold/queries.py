"""The engine's queries over the fixture tables; oracle.py has the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tonefold import lexicon as L
from tonefold import oracle, schemas, shared, views
from tonefold.functions import lexical as X
from tonefold.functions import phrases as P
from tonefold.functions import text as T
from tonefold.operators import backtest as B
from tonefold.operators import diarize as D
from tonefold.operators import returns as R
from tonefold.operators import scorer, tagger
from tonefold.operators import signals as S
from tonefold.operators import stats as St
from tonefold.plans import service
from tonefold.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places (without -0.0), whole numbers as long: what two engines can be held to."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (Ty.DoubleType, Ty.FloatType)):
            c = F.round(c.cast("double"), 6) + 0.0
        elif isinstance(f.dataType, (Ty.IntegerType, Ty.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


raw = views.raw_transcripts


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sentences(D.blocks(D.annotated(raw(spark, sf_dir))))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored(_sentences(spark, sf_dir))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.transcript_signals(_scored(spark, sf_dir))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.returns_index(views.calls(spark, sf_dir), views.bars(spark, sf_dir))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.merged(views.stand_in_signals(spark, sf_dir), _returns(spark, sf_dir))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.configurations(B.held(_trades(spark, sf_dir), *L.SIGNALS, *B.RETURNS))
    return B.positions(rows, B.thresholds(rows))


@query
def lexicon_scores(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.with_scores(docs, F.col("text")).drop("text")


@query
def lexicon_by_lang(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = X.with_scores(views.table(spark, sf_dir, "documents").select("lang", "text"), F.col("text"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.avg("lex_hedge_density").alias("hedge"), F.avg("sentiment_net").alias("net"))


@query
def hedge_phrases(spark, sf_dir):  # noqa: ANN001, ANN201
    return _sentences(spark, sf_dir).select("ticker", "date", "sentence_id", F.array_join(X.hedge_phrases(F.col("text")), "|").alias("phrases"))


@query
def hedge_span_density(spark, sf_dir):  # noqa: ANN001, ANN201
    per = _sentences(spark, sf_dir).groupBy("ticker", "date").agg(F.sum(X.hedge_span_count(F.col("text"))).alias("spans"), F.sum("word_count").alias("n_words"))
    return per.withColumn("span_hedge_density", F.try_divide(F.col("spans").cast("double"), F.col("n_words")))


@query
def clean_text(spark, sf_dir):  # noqa: ANN001, ANN201
    c = T.clean_text(F.col("raw_text"))
    return raw(spark, sf_dir).select("ticker", "date", c.alias("text"), (F.length("raw_text") - F.length(c)).alias("n_dropped"))


@query
def boilerplate_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.lines(raw(spark, sf_dir)).groupBy("ticker", "date").agg(F.count("*").alias("n_lines"), F.count_if("boilerplate").alias("n_boilerplate"))


@query
def html_strip(spark, sf_dir):  # noqa: ANN001, ANN201
    return views.table(spark, sf_dir, "pages").select("page_id", T.html_strip(F.col("html")).alias("text"))


@query
def date_normalize(spark, sf_dir):  # noqa: ANN001, ANN201
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    text = F.lit("soon")
    for i, f in enumerate(("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd")):
        text = F.when(k == i, F.date_format(d, f)).otherwise(text)
    text = F.when(k == 5, F.concat(F.lit("on "), F.date_format(d, "yyyy.MM.dd"))).otherwise(text)
    date = T.normalize_date(F.col("raw"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw")).select("o_orderkey", date.alias("date"), T.is_valid_date(date, "2025-01-01").alias("valid"))


@query
def line_explode(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.lines(raw(spark, sf_dir))


@query
def section_markers(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.annotated(raw(spark, sf_dir)).where("marker is not null").select("ticker", "date", "line_no", "marker")


@query
def section_state(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.annotated(raw(spark, sf_dir)).select("ticker", "date", "line_no", "section_after", "section_flush", "block")


@query
def speaker_headers(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.annotated(raw(spark, sf_dir)).where("is_header").select("ticker", "date", "line_no", "speaker_name", "hint", "speaker_role")


@query
def speaker_blocks(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.blocks(D.annotated(raw(spark, sf_dir))).select("ticker", "date", "block", "speaker_name", "speaker_role", "section", "text")


@query
def sentences(spark, sf_dir):  # noqa: ANN001, ANN201
    return _sentences(spark, sf_dir)


@query
def sentence_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    return _sentences(spark, sf_dir).groupBy("ticker", "date").agg(F.count("*").alias("n_sentences"), F.count_if(F.col("word_count") > 3).alias("n_api"))


@query
def role_section_hist(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.role_section_counts(_sentences(spark, sf_dir))


@query
def preprocess_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.preprocessing_stats(raw(spark, sf_dir), _sentences(spark, sf_dir))


@query
def collection_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    s = St.collection_stats(raw(spark, sf_dir), "2025-01-01")
    pairs = F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.withColumn("sources", F.array_join(F.array_sort(pairs), ",")).withColumn("tickers", F.array_join("tickers", ","))


@query
def call_dates(spark, sf_dir):  # noqa: ANN001, ANN201
    return St.call_dates(raw(spark, sf_dir)).withColumn("dates", F.array_join("dates", ","))


@query
def domain_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    return _sentences(spark, sf_dir).select("ticker", "date", "sentence_id", F.array_join(T.domain_tokens(F.col("text")), "|").alias("found"))


@query
def first_source(spark, sf_dir):  # noqa: ANN001, ANN201
    r = raw(spark, sf_dir)
    return St.first_source(r.where("dataset_row_id < 0"), r.where("source = 'set1/part'"), r.where("source = 'set2/part'")).select("ticker", "date", "source", "dataset_row_id")


@query
def unite_sources(spark, sf_dir):  # noqa: ANN001, ANN201
    r = raw(spark, sf_dir)
    return St.unite(r.where("source = 'set2/part'"), r.where("source = 'set0/part'"), 60, ("dataset_row_id",)).select("source", "dataset_row_id")


@query
def batch_normalize(spark, sf_dir):  # noqa: ANN001, ANN201
    r = raw(spark, sf_dir)
    wide = [r.where(f"source = 'set{k}/part'").select(F.lower("ticker").alias("symbol"), F.col("raw_text").alias(c), F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 5, 2), F.substring("date", 7, 2)).alias("published"), "dataset_row_id") for k, c in enumerate(("content", "transcript", "body"))]
    return readers.united_splits(wide, "dataset_row_id", 80).select("ticker", "date", "dataset_row_id", F.length("raw_text").alias("n_chars"))


@query
def dedup_keep_first(spark, sf_dir):  # noqa: ANN001, ANN201
    return St.keep_first(raw(spark, sf_dir).select("ticker", "source", "dataset_row_id"), ("dataset_row_id",), ("ticker", "source"))


@query
def anti_existing(spark, sf_dir):  # noqa: ANN001, ANN201
    r = raw(spark, sf_dir)
    stored = r.where("dataset_row_id % 4 = 0").select("ticker", "date", F.length("raw_text").alias("size"))
    return St.not_yet_stored(r, stored).select("ticker", "date", "dataset_row_id")


@query
def weak_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(spark, sf_dir).where("word_count >= 5").select("ticker", "date", "sentence_id", "label", "score")


@query
def class_cap(spark, sf_dir):  # noqa: ANN001, ANN201
    return St.class_cap(_scored(spark, sf_dir).where("word_count >= 5").select("ticker", "date", "sentence_id", "label"), 150, ("ticker", "date", "sentence_id"))


@query
def hash_split(spark, sf_dir):  # noqa: ANN001, ANN201
    return St.split(views.table(spark, sf_dir, "labels").select("doc_id"), F.col("doc_id"))


@query
def stratified_split(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = views.table(spark, sf_dir, "labels").withColumnRenamed("quality", "label")
    return St.stratified_split(rows, F.col("doc_id")).select("doc_id", "label", "part")


@query
def macro_f1(spark, sf_dir):  # noqa: ANN001, ANN201
    return St.macro_f1(views.table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted")))


@query
def baseline_evaluation(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = X.with_scores(views.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    rows = docs.join(views.table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")
    return St.macro_f1(rows.select((1 - F.col("quality")).alias("label"), X.weak_label(F.col("sentiment_net")).alias("predicted")))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, sentence_id, text, label (weak) and part of the sentences that a scorer learns from."""
    rows = _scored(spark, sf_dir).where("word_count >= 5").select("ticker", "date", "sentence_id", "text", "label")
    return St.split(rows, F.col("text"))


@query
def trained_scorer(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = shared.written(_labelled(spark, sf_dir), "labelled")
    found = scorer.fit(rows)
    test = scorer.predicted(rows.where("part = 'test'"), found)
    untuned = St.macro_f1(test.withColumn("predicted", F.lit(0))).withColumn("scorer", F.lit("untuned"))
    trained = St.macro_f1(test).withColumn("scorer", F.lit("trained"))
    return trained.unionByName(untuned).withColumn("rounds", F.lit(len(found.history)))


def _phrases(spark: SparkSession, words_only: bool = False) -> DataFrame:
    listed = {*L.hedge_words(), *(() if words_only else L.HEDGE_PHRASES)}
    return spark.createDataFrame([(p,) for p in sorted(listed)], "phrase string")


@query
def phrase_spans(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = _sentences(spark, sf_dir).select("ticker", "date", "sentence_id", "text")
    spans = P.with_spans(rows, "text", _phrases(spark), L.LONGEST_PHRASE)
    return spans.select("ticker", "date", "sentence_id", F.array_join(F.transform("spans", lambda s: s["phrase"]), "|").alias("phrases"), F.size("spans").alias("n_spans"))


@query
def span_scores(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = _sentences(spark, sf_dir).select("text")
    both = P.with_spans(rows, "text", _phrases(spark), L.LONGEST_PHRASE).withColumnRenamed("spans", "expected")
    return P.span_scores(P.with_spans(both, "text", _phrases(spark, words_only=True), 1), "expected", "spans")


@query
def trained_tagger(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = P.with_spans(_labelled(spark, sf_dir).select("text", "part"), "text", _phrases(spark), L.LONGEST_PHRASE).withColumnRenamed("spans", "expected")
    rows = shared.written(P.with_spans(rows, "text", _phrases(spark, words_only=True), 1), "spans")
    found = tagger.fit(rows.where("part = 'train'").select("text", F.col("expected").alias("spans")))
    test = tagger.tagged(rows.where("part = 'test'"), found).withColumn("both", tagger.united(F.col("spans"), F.col("found")))
    parts = [P.span_scores(test, "expected", c).withColumn("source", F.lit(n)) for c, n in (("spans", "words"), ("found", "tagger"), ("both", "united"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def daily_bars(spark, sf_dir):  # noqa: ANN001, ANN201
    return views.bars(spark, sf_dir)


@query
def asof_entry(spark, sf_dir):  # noqa: ANN001, ANN201
    return R.entries(views.calls(spark, sf_dir), views.bars(spark, sf_dir)).select("ticker", "call_date", "entry_date", "entry_price")


@query
def asof_hourly(spark, sf_dir):  # noqa: ANN001, ANN201
    events = views.table(spark, sf_dir, "events").where("ts is not null")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    ticks = events.select(F.col("event_type").alias("ticker"), hour.alias("date"), F.struct("ts", "event_id").alias("at"), (F.coalesce("value", F.lit(0.0)) + 10000.0).alias("p"))
    bars = ticks.groupBy("ticker", "date").agg(F.min_by("p", "at").alias("open"), F.max_by("p", "at").alias("close"))
    calls = events.select("event_type", F.col("ts").alias("call_date")).where("event_type in ('signup', 'purchase')").select(F.when(F.col("event_type") == "signup", "view").otherwise("click").alias("ticker"), "call_date").distinct()
    return R.bucketed_entries(calls, bars, entry="open", width=2 * 86_400, block=64)


@query
def forward_returns(spark, sf_dir):  # noqa: ANN001, ANN201
    return _returns(spark, sf_dir)


@query
def returns_null_share(spark, sf_dir):  # noqa: ANN001, ANN201
    return R.null_shares(_returns(spark, sf_dir))


@query
def ticker_allow_list(spark, sf_dir):  # noqa: ANN001, ANN201
    listed = views.table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ticker"))
    return R.in_universe(views.calls(spark, sf_dir), listed)


@query
def price_window(spark, sf_dir):  # noqa: ANN001, ANN201
    return R.price_window(views.calls(spark, sf_dir))


@query
def transcript_signals(spark, sf_dir):  # noqa: ANN001, ANN201
    return _signals(spark, sf_dir).drop("has_qa", "certainty", "specificity")


@query
def confidence_score(spark, sf_dir):  # noqa: ANN001, ANN201
    return _signals(spark, sf_dir).select("ticker", "call_date", "certainty", "specificity", "has_qa", "confidence_score")


@query
def alpha_composite(spark, sf_dir):  # noqa: ANN001, ANN201
    return S.alpha(_signals(spark, sf_dir)).select("ticker", "call_date", "alpha_signal")


@query
def qoq_delta(spark, sf_dir):  # noqa: ANN001, ANN201
    return S.qoq_delta(_signals(spark, sf_dir)).select("ticker", "call_date", "confidence_delta")


@query
def zscore_expanding(spark, sf_dir):  # noqa: ANN001, ANN201
    return S.zscore_history(views.stand_in_signals(spark, sf_dir)).select("ticker", "call_date", "confidence_z")


@query
def signal_returns_join(spark, sf_dir):  # noqa: ANN001, ANN201
    return _trades(spark, sf_dir).select("ticker", "call_date", "trade_date", "confidence_score", *B.RETURNS)


@query
def quantile_positions(spark, sf_dir):  # noqa: ANN001, ANN201
    return _positions(spark, sf_dir).select("config", "ticker", "call_date", "position", "trade_return")


@query
def backtest_single(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.single(_trades(spark, sf_dir))


@query
def backtest_grid(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.grid(_trades(spark, sf_dir))


@query
def backtest_best(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.best(B.grid(_trades(spark, sf_dir)))


@query
def key_figures(spark, sf_dir):  # noqa: ANN001, ANN201
    return service.key_figures(B.best(B.grid(_trades(spark, sf_dir))))


@query
def equity_curve(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.equity_curve(_positions(spark, sf_dir))


@query
def max_drawdown(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.max_drawdown(_positions(spark, sf_dir))


@query
def pearson(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.pearson(_trades(spark, sf_dir))


@query
def pearson_p_values(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.p_values(B.pearson(_trades(spark, sf_dir)))


@query
def ic_by_quarter(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.ic_by_quarter(_trades(spark, sf_dir))


@query
def quintile_returns(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.quintile_returns(_trades(spark, sf_dir))


@query
def sharpe_rollup(spark, sf_dir):  # noqa: ANN001, ANN201
    users = views.table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("sector")).distinct()
    return B.sharpe_rollup(_positions(spark, sf_dir), users)


@query
def oos_split(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.out_of_sample(_trades(spark, sf_dir), "20240115")


@query
def walk_forward(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.walk_forward(_trades(spark, sf_dir), ["20240108", "20240115", "20240122"])


@query
def ablation(spark, sf_dir):  # noqa: ANN001, ANN201
    return B.ablation(_trades(spark, sf_dir), {"model_only": F.col("qa_sentiment"), "lexicon_only": F.col("hedge_density"), "composite": 0.5 * F.col("confidence_score") + 0.5 * F.col("qa_sentiment")})


@query
def ticker_lookup(spark, sf_dir):  # noqa: ANN001, ANN201
    return service.signals_of(_signals(spark, sf_dir).drop("has_qa", "certainty", "specificity"), "tk5")


@query
def latency_percentiles(spark, sf_dir):  # noqa: ANN001, ANN201
    return St.latency_percentiles(views.table(spark, sf_dir, "events"), "value", "event_type")


@query
def latency_by_week(spark, sf_dir):  # noqa: ANN001, ANN201
    hours = shared.written(St.latency_sketches(views.table(spark, sf_dir, "events"), "value", "ts", "event_type"), "sketches")
    days = St.latency_over(hours, "day", "event_type").withColumn("unit", F.lit("day"))
    return days.unionByName(St.latency_over(hours, "week", "event_type").withColumn("unit", F.lit("week")))


def _place(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared.root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query
def transcript_files(spark, sf_dir):  # noqa: ANN001, ANN201
    path = _place(spark, "raw")
    sinks.write_raw_files(raw(spark, sf_dir), path)
    return readers.raw_transcripts(spark, path).select("ticker", "date", "source", "dataset_row_id", F.length("raw_text").alias("n_chars"), F.md5(F.col("raw_text").cast("binary")).alias("digest"))


@query
def sentence_files(spark, sf_dir):  # noqa: ANN001, ANN201
    path = f"{_place(spark, 'sentences')}/parquet"
    sinks.write_sentences(_sentences(spark, sf_dir), path)
    return readers.sentences(spark, path)


@query
def price_files(spark, sf_dir):  # noqa: ANN001, ANN201
    path = _place(spark, "prices")
    sinks.write_prices(views.bars(spark, sf_dir), path)
    stored = readers.prices(spark, path)
    return readers.with_fallback(stored.where("ticker < 'U5'"), stored)


@query
def return_files(spark, sf_dir):  # noqa: ANN001, ANN201
    path = _place(spark, "returns")
    sinks.write_returns(_returns(spark, sf_dir), path)
    return spark.read.schema(schemas.RETURNS_INDEX).parquet(path)


@query
def signal_files(spark, sf_dir):  # noqa: ANN001, ANN201
    path = _place(spark, "signals")
    sinks.write_signals(_signals(spark, sf_dir).drop("has_qa", "certainty", "specificity"), path)
    return readers.signals(spark, path)


@query
def result_files(spark, sf_dir):  # noqa: ANN001, ANN201
    path = _place(spark, "results")
    results = B.grid(_trades(spark, sf_dir))
    sinks.write_results(B.results_json(results), path)
    stored = spark.read.text(path).select(F.from_json("value", Ty.StructType([Ty.StructField("optimal_primary_strategy", results.schema), Ty.StructField("ablation_tests", Ty.ArrayType(results.schema))])).alias("x"))
    tests = stored.select(F.col("x.optimal_primary_strategy.config").alias("best"), F.explode("x.ablation_tests").alias("t"))
    return tests.select("t.config", "t.actual_signal_used", "t.holding_period", "t.total_trades", "t.annualized_sharpe_ratio", (F.col("best") == F.col("t.config")).alias("is_best"))


@query
def matcher_files(spark, sf_dir):  # noqa: ANN001, ANN201
    path = _place(spark, "matcher")
    sinks.write_matcher(spark, path)
    pattern = readers.matcher(spark, path)
    return _sentences(spark, sf_dir).select("ticker", "date", "sentence_id", F.size(X.hedge_spans(F.col("text"), pattern=pattern)).alias("n_spans"))


@query
def dictionary_scan(spark, sf_dir):  # noqa: ANN001, ANN201
    path = _place(spark, "dictionary")
    words = views.table(spark, sf_dir, "documents").select(F.explode(T.alpha_tokens(F.col("text"))).alias("w")).distinct()
    n = F.length("w")
    flags = {"Negative": n % 3 - 1, "Positive": (n % 4 == 0).cast("int") * 2009, "Strong_Modal": F.when(n > 8, 1).otherwise(0), "Syllables": n}
    words.select(F.upper("w").alias("Word"), *[c.alias(k) for k, c in flags.items()]).write.option("header", True).csv(path)
    return readers.dictionary(spark, path)


@query
def analyze_requests(spark, sf_dir):  # noqa: ANN001, ANN201
    blocks = D.blocks(D.annotated(raw(spark, sf_dir)))
    return service.analyze_all(blocks.select(F.concat_ws(":", "ticker", "date", "block").alias("id"), "text"))


ORACLE: dict[str, str] = dict(oracle.SQL)
assert set(ORACLE) <= set(QUERIES) and L.FINANCE
