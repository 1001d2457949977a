"""Column functions on transcript text. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonefold import lexicon as L

#: White space as str.strip() and str.split() see it.
_WS = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Straight quotes and dashes, plain blanks; at most two newlines and one blank in a row; stripped."""
    c = F.translate(c, "’‘“”–— ", "''\"\"-- ")
    c = F.regexp_replace(c, r"(?U)[^\S\n]", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, " {2,}", " "))


def html_strip(c: Column) -> Column:
    """Tags become blanks, white space single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def html_blocks(c: Column) -> Column:
    """As html_strip(), but ends of block elements stay line breaks, so that line operators work on filings."""
    c = F.regexp_replace(c, r"(?i)</(p|div|h[1-6]|li|tr|article|section)>|<br\s*/?>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"[^\S\n]+", " ")
    return strip(F.regexp_replace(c, r" ?\n[ \n]*", "\n"))


def is_boilerplate(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) < 3) | s.rlike("(?i)" + "|".join(L.BOILERPLATE))


def _any_of(c: Column, keywords: list[str], word_boundary: bool) -> Column:
    """Whether lower-cased c holds any keyword, as a substring or between word boundaries."""
    quoted = "|".join(f"\\Q{k}\\E" for k in keywords)
    return F.lower(c).rlike(rf"(?U)\b(?:{quoted})\b" if word_boundary else quoted)


def section_marker(c: Column, word_boundary: bool = False) -> Column:
    """qa or remarks where a line announces a section (qa markers first), else null."""
    return F.when(_any_of(c, L.QA_MARKERS, word_boundary), "qa").when(_any_of(c, L.REMARKS_MARKERS, word_boundary), "remarks")


def is_header(c: Column) -> Column:
    return strip(c).rlike(L.HEADER)


def speaker_name(c: Column) -> Column:
    return strip(F.regexp_extract(strip(c), L.HEADER, 1))


def role_hint(c: Column) -> Column:
    return strip(F.regexp_extract(strip(c), L.HEADER, 2))


def speaker_role(name: Column, hint: Column, word_boundary: bool = False) -> Column:
    """operator, ceo, cfo, analyst or other: the first role of which a keyword occurs."""
    both = F.concat_ws(" ", name, hint)
    out = None
    for role, words in L.ROLE_KEYWORDS.items():
        hit = _any_of(both, words, word_boundary)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("other")


#: A sentence ends at punctuation that follows neither a digit, a capital nor ".x", before white space and a capital.
SENTENCE_END = r"(?<![0-9A-Z])(?<!\.[\p{L}\p{N}_])[.!?]+\s+(?=[A-Z])"


def split_sentences(c: Column) -> Column:
    """Stripped, non-empty sentences; none if the text has fewer than 10 characters."""
    parts = F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda x: x != "")
    return F.when(F.length(strip(c)) >= 10, parts).otherwise(F.array().cast("array<string>"))


def words(c: Column) -> Column:
    return F.filter(F.split(c, _WS), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def alpha_tokens(c: Column) -> Column:
    """Lower-case a-z runs that stand between word boundaries."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b([a-z]+)\b"), F.lit(1))


def domain_tokens(c: Column) -> Column:
    """Figures, quarters and acronyms: $2.3B, Q3, EBITDA."""
    return F.regexp_extract_all(c, F.lit(r"\$?\d[\d.,]*[BMK%]?|Q[1-4]|[A-Z]{2,}"), F.lit(0))


def has_digit(c: Column) -> Column:
    return c.rlike(r"\d")


def keeps_sentence(c: Column, least_chars: int = 15, least_words: int = 3) -> Column:
    return (F.length(c) >= least_chars) & (word_count(c) >= least_words)


#: Date formats in the order in which they are tried.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d-M-yyyy", "yyyyMMdd")


def normalize_date(c: Column) -> Column:
    """YYYYMMDD: the first format that fits, else the digits if they are eight (not validated), else 19000101."""
    digits = F.regexp_replace(c, r"\D", "")
    tried = [F.date_format(F.try_to_date(c, f), "yyyyMMdd") for f in DATE_FORMATS]
    return F.coalesce(*tried, F.when(F.length(digits) == 8, digits), F.lit("19000101"))


def is_valid_date(c: Column, as_of: str) -> Column:
    """Whether a YYYYMMDD string is a date from 2015-01-01 to as_of."""
    d = F.try_to_date(c, "yyyyMMdd")
    return F.coalesce(d.between(F.lit("2015-01-01").cast("date"), F.lit(as_of).cast("date")), F.lit(False))


def normalize_ticker(*cols: Column, row: Column) -> Column:
    """The first non-empty column, upper case and trimmed; else UNKNOWN_nnnn from the row's number."""
    return F.coalesce(*[F.nullif(F.upper(F.trim(c)), F.lit("")) for c in cols], F.format_string("UNKNOWN_%04d", row))


def first_text(named: list[Column], others: list[Column]) -> Column:
    """The first non-empty of the named columns, else the first other one with over 500 characters."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in named], *[F.when(F.length(c) > 500, c) for c in others])


def clean_ticker(c: Column, longest: int | None = None) -> Column:
    """Without characters other than letters, digits and underscores; cut to `longest` only where wanted (cut keys collide)."""
    out = F.regexp_replace(c, r"(?U)[^\w]", "")
    return out if longest is None else F.substring(out, 1, longest)


def source_family(c: Column) -> Column:
    return F.split_part(c, F.lit("/"), F.lit(1))
