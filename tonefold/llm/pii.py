"""Information-theoretic sanitisation of personal data, in DataFrame and SQL functions only.

Base spans come from patterns: e-mail and IP addresses, payment cards, telephone numbers. Every distinct value is a
protected entity. Over the whole corpus, the words of its documents are counted with an entity, and a word's
pointwise mutual information with the entity is held against the entity's information content:

    PMI(t; e) = log(P(e | t) N / n(e))  >=  IC(e) / alpha = log(N / n(e)) / alpha
    P(e | t) = (n(t, e) + prior n(e) / N) / (n(t) + prior)

(n: documents; n(t, e): documents that hold both; smoothed by `prior` documents in which t and e are independent, so that
an entity of a single document can be told too). Words are runs of letters and digits outside base spans, short ones too, as names can be; they count in any place of a document.
Such a word gives the entity away; in the documents that hold the entity its occurrences become spans of kind term.
sanitised() generalises base spans to their kind and generalises or removes the terms.

Offsets are code points, ends exclusive. A null text counts as empty. Texts of any length and number of matches take time little
more than in proportion. Repeated rows (doc_id and text) get the same spans each and count as one document in the statistics. A word whose information
equals the threshold is hidden. Other columns, whatever their names, are kept by sanitised() and ignored by spans().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread

#: The kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the patterns, and no second attempt within a run of characters that has failed, so that
#: a search takes linear time; cards need 16 digits, so shorter runs aren't matched at all.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"
#: A word.
_RUN = r"[\p{L}\p{Nd}]+"
#: Code points of the pieces into which a text is cut, so that parts of it are found without reading it from its start.
_PIECE = 4096
_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_SHORT = "regexp_replace(p, '^0+(?=[0-9])', '')"
_VALID = {
    "email": "true",
    "ip": f"forall(split(x.value, '[.]'), p -> char_length({_SHORT}) <= 3 and coalesce(try_cast({_SHORT} as int), 999) <= 255)",
    "card": f"""char_length({_DIGITS}) <= 19 and aggregate(sequence(1, char_length({_DIGITS})), 0, (a, i) -> a +
        cast(substr({_DIGITS}, -i, 1) as int) * (1 + (i + 1) % 2) - if(i % 2 = 0 and cast(substr({_DIGITS}, -i, 1) as int) > 4, 9, 0)) % 10 = 0""",
    "phone": f"char_length({_DIGITS}) between 8 and 15",
}


def _scan(xs: Column, init: Column, step: Callable, emit: Callable, kind: str) -> Column:
    """Array of emit(s, x) for each x of the array xs; the number s is init at first and then step(s, x), from one x to the next.

    As appending to an array copies it, an array of n is gone through in slices of about the root of n.
    """
    width = F.ceil(F.sqrt(F.size(xs))).cast("int")
    part = lambda b: F.slice(xs, b * width + 1, width)
    slices = F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1)
    starts = F.aggregate(
        slices,
        F.struct(init.alias("s"), F.array().cast("array<bigint>").alias("starts")),
        lambda a, b: F.struct(F.aggregate(part(b), a["s"], step).alias("s"), F.concat(a["starts"], F.array(a["s"])).alias("starts")),
        lambda a: a["starts"],
    )
    none = F.array().cast(f"array<{kind}>")
    inside = lambda s, b: F.aggregate(
        part(b),
        F.struct(s.alias("s"), none.alias("out")),
        lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(emit(a["s"], x).cast(kind))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(F.size(xs) > 0, F.flatten(F.transform(starts, inside))).otherwise(none)


def _occurrences(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """df with a column name: start, end and value of every match in its column text, left to right."""
    df = df.withColumn("m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("g", F.when(F.size("m") > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn("z", F.when(F.size("m") > 0, F.zip_with("m", F.expr("slice(g, 2, size(m))"), lambda v, gap: F.struct(v.alias("v"), F.char_length(v).cast("long").alias("n"), F.char_length(gap).alias("gap")))))
    found = _scan(F.col("z"), F.char_length(F.col("g")[0]).cast("long"), lambda s, x: s + x["n"] + x["gap"], lambda s, x: F.struct(s.alias("start"), (s + x["n"]).alias("end"), x["v"].alias("value")), _SPANS[6:-1])
    return df.withColumn(name, F.coalesce(found, F.array().cast(_SPANS))).drop("m", "g", "z")


def _replaced(df: DataFrame, text: str, spans: str, mark: Callable[[Column], Column], name: str) -> DataFrame:
    """df with a column name: the column text with mark(span) for each of its spans (array of structs that begin with start, end; in order of start).
    Where spans overlap, a mark stands for what lies beyond the spans before; mark() gets pos, the end of those."""
    kind = df.schema[spans].dataType.elementType
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in kind.fields)
    df = df.withColumn("cuts", _scan(F.col(spans), F.lit(0).cast("long"), lambda s, x: F.greatest(s, x["end"]), lambda s, x: F.struct(s.alias("pos"), *[x[f.name].alias(f.name) for f in kind.fields]), f"struct<pos:bigint,{fields}>"))
    df = df.withColumn("pieces", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))

    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / _PIECE).cast("int"), F.floor((b - 1) / _PIECE).cast("int")
        piece = lambda c: F.substr(F.col("pieces")[c], (F.greatest(a - c * _PIECE, F.lit(0)) + 1).cast("int"), (F.least(b - c * _PIECE, F.lit(_PIECE)) - F.greatest(a - c * _PIECE, F.lit(0))).cast("int"))
        return F.when(a < b, F.array_join(F.transform(F.sequence(first, last), piece), "")).otherwise("")

    end = F.coalesce(F.array_max(F.transform("cuts", lambda c: c["end"])), F.lit(0).cast("long"))
    parts = F.concat(F.transform("cuts", lambda c: F.concat(between(c["pos"], c["start"]), mark(c))), F.array(between(end, F.char_length(text).cast("long"))))
    return df.withColumn(name, F.array_join(parts, "")).drop("cuts", "pieces")


def base(docs: DataFrame) -> DataFrame:
    """docs (text) with a column for each kind: its valid matches."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        df = _occurrences(df, "text", _PATTERNS[kind], kind)
        if _VALID[kind] != "true":
            df = df.withColumn(kind, F.expr(f"filter({kind}, x -> {_VALID[kind]})"))
    return df


def _words(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), F.lower)


def disclosing(docs: DataFrame, found: DataFrame, scratch: Scratch, alpha: float = 1.25, prior: float = 0.1) -> DataFrame:
    """row, term: of the rows of found (row, text, masked: the text without base spans, spans of all kinds), the words to hide in each.

    found: only documents with base spans. docs: row and text of all documents; repeated rows count once.
    """
    rows, different = docs.agg(F.count("*"), F.countDistinct("row")).first()
    once = docs.select("row", "text") if rows == different else docs.select("row", "text").distinct()  # texts needn't be dealt out where no row repeats
    total = float(max(different, 1))
    each = lambda df, text, n: df.select(F.explode(F.array_distinct(_words(text))).alias("term"), F.lit(n).alias("n"))
    counts = each(once, "text", 1).unionByName(each(found, "text", -1)).unionByName(each(found, "masked", 1))  # parts of base spans aren't words
    held = scratch.table(counts.groupBy("term").agg(F.sum("n").alias("n_t")).where("n_t > 0"), "held")
    holds = scratch.table(found.select("row", F.explode("spans").alias("x")).select("row", F.concat_ws(":", "x.kind", F.lower("x.value")).alias("entity")).distinct(), "holds")
    # entities of the same documents are told by the same words: they are one from here on, known by the number of rows and two sums of them
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "row")) for seed in (1, 2)]
    entities = holds.groupBy("entity").agg(F.count("*").alias("n_e"), *[x.alias(f"x{i}") for i, x in enumerate(same)])
    holds = scratch.table(holds.join(entities, "entity").select("row", "n_e", F.concat_ws(":", "n_e", "x0", "x1").alias("entity")).distinct(), "entities")
    # as n(t, e) <= n(e), a more frequent word can't reach the threshold: words are dropped by this bound, which loses none, before pairs are made
    most = lambda n: (F.col(n) + prior * F.col(n) / total) * F.pow(total / F.col(n), F.lit(1 - 1 / alpha)) * (1 + 1e-9)
    tops = holds.groupBy("row").agg(F.max("n_e").alias("top_e"))
    near = found.select("row", F.explode(F.array_distinct(_words("masked"))).alias("term")).join(tops, "row")
    top = tops.agg(F.max("top_e").alias("top_e")).first()["top_e"] or 1
    rare = held.where(F.col("n_t") + prior <= (top + prior * top / total) * (total / top) ** (1 - 1 / alpha) * (1 + 1e-9))
    near = scratch.table(near.join(rare, "term").where(F.col("n_t") + prior <= most("top_e")).select("row", "term", "n_t"), "near")
    pairs = near.join(holds, "row").where(F.col("n_t") + prior <= most("n_e"))
    pmi = F.log((F.col("n_te") + prior * F.col("n_e") / total) / (F.col("n_t") + prior) * total / F.col("n_e"))
    told = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te")).where(pmi >= F.log(total / F.col("n_e")) / F.lit(alpha)).select("entity", "term")
    return pairs.select("row", "entity", "term").join(told, ["entity", "term"]).select("row", "term").distinct()


def _row(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart: a document's id and text, as 128 bits."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def spans(docs: DataFrame, alpha: float = 1.25, prior: float = 0.1) -> DataFrame:
    """doc_id, row, one column of spans for each kind, term (spans of disclosing words outside the base spans)."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", _row())
    every = F.concat(*[F.expr(f"transform({k}, x -> struct(x.start as start, x.end as end, '{k}' as kind, x.value as value))") for k in KINDS])
    known = base(rows).withColumn("spans", F.array_sort(every))
    known = known.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))  # only these are looked at again
    known = scratch.table(known, "base")
    # values of the patterns aren't words of the text: they are hidden anyway
    blank = lambda c: F.repeat(F.lit(" "), F.greatest(c["end"] - F.greatest(c["pos"], c["start"]), F.lit(0)).cast("int"))
    some = known.where("size(spans) > 0").select("row", "text", "spans").dropDuplicates(["row"])
    some = scratch.table(_replaced(some, "text", "spans", blank, "masked").select("row", "text", "masked", "spans"), "masked")
    hide = scratch.table(disclosing(rows.select("row", "text"), some, scratch, alpha, prior), "hide")
    words = _occurrences(spread(some.select("row", "masked"), "row"), "masked", _RUN, "term")
    words = words.select("row", F.explode(F.filter("term", lambda x: x["start"] < x["end"])).alias("at"))  # of a plain column Spark infers a filter, for which it is made thrice
    told = words.withColumn("term", F.lower("at.value")).join(hide, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("term"))  # as many as the document has words
    both = known.join(scratch.table(told, "told"), "row", "left")
    return both.select("doc_id", "row", *KINDS, F.coalesce("term", F.array().cast(_SPANS)).alias("term"))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    found = spans(docs)
    names = F.array_join(F.concat(*map(_named, KINDS)), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "term")]
    return found.select("doc_id", *counts, F.sha2(names.cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(*map(_named, (*KINDS, "term"))), ",").alias("spans"))


def sanitised(docs: DataFrame, generalise_terms: bool = True) -> DataFrame:
    """docs with texts in which base spans read [EMAIL], [IP], [CARD] or [PHONE] and terms read [TERM] (or are removed);
    where spans overlap, the one that begins first (the longest of these) counts and the others' rest goes with it."""
    mark = lambda k: f"[{k.upper()}]" if k != "term" or generalise_terms else ""
    every = F.concat(*[F.expr(f"transform({k}, x -> struct(x.start as start, -x.end as less, x.end as end, '{mark(k)}' as mark))") for k in (*KINDS, "term")])
    key, clean = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("row", "text"))
    found = spans(docs).select("row", F.transform(F.array_sort(every), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["mark"].alias("mark"))).alias("spans")).dropDuplicates(["row"]).where("size(spans) > 0")
    texts = docs.select(_row().alias("row"), "text").dropDuplicates(["row"]).join(found, "row")
    done = _replaced(texts, "text", "spans", lambda c: F.when(c["start"] >= c["pos"], c["mark"]).otherwise(""), clean).select(F.col("row").alias(key), clean)
    return docs.join(done, _row() == F.col(key), "left").withColumn("text", F.coalesce(clean, "text")).select(*[F.col(f"`{c}`") for c in docs.columns])
