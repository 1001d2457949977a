"""Column functions that score text against a lexicon. The lexicon is a parameter; all run inside the JVM."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonefold import lexicon as L
from tonefold.functions import text as T


def _hits(tokens: Column, words: list[str]) -> Column:
    """How many tokens are in words; membership is a hash set, not a scan of an array."""
    return F.size(F.filter(tokens, lambda t: t.isin(words))) if words else F.lit(0)


def category_counts(c: Column, lexicon: L.Lexicon = L.FINANCE) -> dict[str, Column]:
    """n_tokens and a count for each category (a token in several categories counts in each)."""
    tokens = T.alpha_tokens(c)
    return {"n_tokens": F.coalesce(F.size(tokens), F.lit(0)), **{k: F.coalesce(_hits(tokens, sorted(w)), F.lit(0)) for k, w in lexicon.items()}}


def scores(counts: dict[str, Column]) -> dict[str, Column]:
    """Shares of tokens by category, lex_hedge_density (the three hedge categories added up) and sentiment_net; 0 without tokens."""
    n = counts["n_tokens"]
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))
    out = {k: share(v) for k, v in counts.items() if k != "n_tokens"}
    zero = F.lit(0)
    hedge = sum((counts.get(k, zero) for k in L.HEDGE_CATEGORIES), zero)
    out["lex_hedge_density"] = share(hedge)
    out["sentiment_net"] = share(counts.get("positive", zero) - counts.get("negative", zero))
    return out


def with_scores(df: DataFrame, c: Column, lexicon: L.Lexicon = L.FINANCE) -> DataFrame:
    """df with n_tokens and scores(). A text's tokens are found once: they are a column, and so are the counts, on which the shares build."""
    own = uuid.uuid4().hex[:8]
    tokens = f"_tokens_{own}"
    df = df.withColumn(tokens, T.alpha_tokens(c))
    counts = {"n_tokens": F.size(tokens), **{k: _hits(F.col(tokens), sorted(w)) for k, w in lexicon.items()}}
    df = df.select("*", *[F.coalesce(x, F.lit(0)).alias(f"_{k}_{own}") for k, x in counts.items()])
    held = {k: F.col(f"_{k}_{own}") for k in counts}
    return df.select("*", held["n_tokens"].alias("n_tokens"), *[x.alias(k) for k, x in scores(held).items()]).drop(tokens, *[f"_{k}_{own}" for k in counts])


def weak_label(net: Column, margin: float = 0.01) -> Column:
    """0 positive, 1 negative, 2 neutral."""
    return F.when(net > margin, 0).when(net < -margin, 1).otherwise(2)


def label_score(label: Column) -> Column:
    return F.when(label == 0, 1).when(label == 1, -1).otherwise(0)


def hedge_phrases(c: Column, lexicon: L.Lexicon = L.FINANCE) -> Column:
    """Hedge words in text order, then hits of the hedge patterns in pattern order; each once."""
    cleaned = F.transform(T.words(c), lambda w: F.regexp_replace(F.lower(w), r"(?U)[^\w]", ""))
    found = F.filter(cleaned, lambda w: w.isin(L.hedge_words(lexicon)))
    hits = [F.transform(F.regexp_extract_all(c, F.lit("(?iU)" + p), F.lit(0)), lambda h: T.strip(F.lower(h))) for p in L.HEDGE_PATTERNS]
    return F.coalesce(F.array_distinct(F.concat(found, *hits)), F.array().cast("array<string>"))


def span_pattern(lexicon: L.Lexicon = L.FINANCE) -> str:
    """One alternation of phrases and single hedge words, longest first, so the leftmost longest span wins."""
    return alternation({*L.HEDGE_PHRASES, *L.hedge_words(lexicon)})


def alternation(phrases: Iterable[str]) -> str:
    ranked = sorted(phrases, key=lambda p: (-len(p), p))
    return "|".join(p.replace(" ", r"\s+") for p in ranked)


def hedge_spans(c: Column, lexicon: L.Lexicon = L.FINANCE, pattern: str | None = None) -> Column:
    """Non-overlapping hedge spans, case ignored, from left to right. pattern: alternation() of a stored matcher's phrases, in place of the lexicon's."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?U)\b(?:{pattern or span_pattern(lexicon)})\b"), F.lit(0))


def hedge_span_count(c: Column, lexicon: L.Lexicon = L.FINANCE) -> Column:
    return F.coalesce(F.regexp_count(F.lower(c), F.lit(rf"(?U)\b(?:{span_pattern(lexicon)})\b")), F.lit(0))
