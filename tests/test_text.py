"""Text functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from tonefold.functions import lexical as X
from tonefold.functions import text as T


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, None), ("", ""), ("  a ’b’  –  c\n\n\n\nd\t", "a 'b' - c\n\nd"), ("“x” ", '"x"'), (" \n ", "")],
)
def test_clean_text(spark, text, want):
    assert one(spark, text, T.clean_text) == want


@pytest.mark.parametrize(("line", "want"), [("ab", True), ("  ", True), ("Copyright 2024 X", True), ("[ Applause ]", True), ("Forward-looking statements apply", True), ("Revenue grew", False), ("Page 3 of 9", True)])
def test_boilerplate(spark, line, want):
    assert one(spark, line, T.is_boilerplate) is want


@pytest.mark.parametrize(("line", "want"), [("Our Q&A begins", "qa"), ("Good morning and question-and-answer", "qa"), ("Good evening", "remarks"), ("Nothing", None)])
def test_section_marker(spark, line, want):
    assert one(spark, line, T.section_marker) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [("Ann Lee: Chief Executive Officer", ("Ann Lee", "Chief Executive Officer", "ceo")), ("Ann Lee - CFO", ("Ann Lee - CFO", "", "cfo")), ("Operator:", ("Operator", "", "operator")), ("We grew 5% in 2024.", None), ("Jo Doe: Goldman analyst", ("Jo Doe", "Goldman analyst", "analyst"))],
)
def test_headers(spark, line, want):
    got = spark.createDataFrame([(line,)], "t string").select(T.is_header(F.col("t")).alias("h"), T.speaker_name(F.col("t")).alias("n"), T.role_hint(F.col("t")).alias("r"))
    row = got.select("*", T.speaker_role(F.col("n"), F.col("r")).alias("role")).first()
    assert row.h is (want is not None)
    if want:
        assert (row.n, row.r, row.role) == want


def test_sentences_split_where_the_rule_says(spark):
    text = "We grew 5.5. Not here. But Here! Up in Q3. And U.S. Sales rose?! Yes it did."
    assert one(spark, text, T.split_sentences) == ["We grew 5.5. Not here", "But Here", "Up in Q3. And U.S. Sales rose", "Yes it did."]
    assert one(spark, "short", T.split_sentences) == []


@pytest.mark.parametrize(("raw", "want"), [("2024-2-3", "20240203"), ("2024/02/03", "20240203"), ("2/3/2024", "20240203"), ("3-2-2024", "20240203"), ("20240203", "20240203"), ("on 2024.02.03", "20240203"), ("99999999", "99999999"), ("soon", "19000101"), ("", "19000101")])
def test_dates(spark, raw, want):
    assert one(spark, raw, T.normalize_date) == want


def test_tokens(spark):
    assert one(spark, "Can't été a1 b_c Growth", T.alpha_tokens) == ["can", "t", "growth"]
    assert one(spark, "EBITDA of $2.3B in Q3", T.domain_tokens) == ["EBITDA", "$2.3B", "Q3"]
    assert one(spark, " a  b\n", T.word_count) == 2
    assert one(spark, None, T.word_count) == 0


HEDGED = [
    "We expect revenues to grow approximately 5% to 8%, subject to market conditions.",
    "There can be no assurance that we will achieve the projected results.",
    "Can you clarify whether the margin expansion will persist into next year?",
]


@pytest.mark.parametrize("text", HEDGED)
def test_hedge_phrases_found(spark, text):
    assert one(spark, text, X.hedge_phrases)


@pytest.mark.parametrize("text", ["We delivered record revenue of $12.3 billion this quarter.", "We are confident in our ability to exceed our annual guidance.", "", None])
def test_no_hedge_phrases(spark, text):
    assert one(spark, text, X.hedge_phrases) == []


@pytest.mark.parametrize(
    ("text", "n"),
    [("We expect margins to potentially decrease next year.", 2), ("The growth was strong this quarter.", 0), ("Subject to market conditions, we estimate $1B.", 3), ("We believe there is uncertainty in the forecast.", 2), (None, 0)],
)
def test_hedge_spans(spark, text, n):
    assert one(spark, text, X.hedge_span_count) == n


def test_spans_are_leftmost_longest(spark):
    assert one(spark, "We expect it, subject to change.", X.hedge_spans) == ["we expect", "subject to change"]


def test_scores(spark):
    df = spark.createDataFrame([("Revenue increased to $5 billion, exceeding our target by 12%.",), ("",), (None,)], "t string")
    rows = df.select(*[c.alias(k) for k, c in X.scores(X.category_counts(F.col("t"))).items()]).collect()
    assert 0 < rows[0].lex_hedge_density < 0.15
    assert all(v == 0.0 for r in rows[1:] for v in r)


def test_html(spark):
    assert one(spark, "<p>a<b>b</b>\n c</p>", T.html_strip) == "a b c"
    assert one(spark, "<p>a</p><p>b</p>", T.html_blocks) == "a\nb"
