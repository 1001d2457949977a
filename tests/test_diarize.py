"""The windowed section and block logic against blocks written by hand and against its rules, stated by place."""

import itertools
import random
import re

from tonefold import lexicon as L
from tonefold.operators import diarize as D

LINES = [
    "Good morning, and welcome to all 2024.", "We turn to q&a, number 2.", "Ann Lee: Chief Executive Officer", "Cy Poe: Analyst", "Bo Roe - CFO", "Operator:",
    "Revenue of $5 grew and grew again.", "It was, in all, a fine year for us!", "[Applause]", "ab", "Copyright 2024 q&a", "We said: good morning, 1 2 3.", "Nobody At All",
]


def stated(text):
    """The rules as statements about places: a block's lines lie between two headers; its section is the last marker up to the header
    that ends it, or else the first speaker who is named before that header and tells a section."""
    lines = [x for x in map(str.strip, text.split("\n")) if len(x) > 2 and not re.search("|".join(L.BOILERPLATE), x, re.I)]
    marks = ["qa" if any(m in x.lower() for m in L.QA_MARKERS) else "remarks" if any(m in x.lower() for m in L.REMARKS_MARKERS) else None for x in lines]
    heads = {i: m for i, x in enumerate(lines) if (m := re.match(L.HEADER, x))}
    named = {i: ((m[1] or "").strip(), (m[2] or "").strip()) for i, m in heads.items()}
    roles = {i: next((r for r, keys in L.ROLE_KEYWORDS.items() if any(k in " ".join(n).lower() for k in keys)), "other") for i, n in named.items()}
    tells = {i: {"analyst": "qa", "ceo": "remarks", "cfo": "remarks"}[r] for i, r in roles.items() if r in ("analyst", "ceo", "cfo")}
    edges, out = [-1, *heads, len(lines)], []
    for begin, end in itertools.pairwise(edges):
        said = [m for m in marks[: end + 1] if m][-1:] or [t for i, t in tells.items() if i < end][:1] or ["unknown"]
        if body := " ".join(lines[begin + 1 : end]).strip():
            out.append((named.get(begin, ("unknown",))[0], roles.get(begin, "other"), said[0], body))
    return out


#: Blocks (speaker, role, section, text) of short transcripts, written by hand.
BY_HAND = [
    ("", []),
    ("Revenue of $5 grew and grew again.", [("unknown", "other", "unknown", "Revenue of $5 grew and grew again.")]),
    ("Ann Lee: Chief Executive Officer\nIt was, in all, a fine year for us!", [("Ann Lee", "ceo", "remarks", "It was, in all, a fine year for us!")]),
    ("Cy Poe: Analyst\nOne, two or 3?\nAnn Lee: Chief Executive Officer\nIt was 4, in all.", [("Cy Poe", "analyst", "qa", "One, two or 3?"), ("Ann Lee", "ceo", "qa", "It was 4, in all.")]),
    ("Ann Lee: Chief Executive Officer\nIt was 4, in all.\nWe turn to q&a, number 2.", [("Ann Lee", "ceo", "qa", "It was 4, in all. We turn to q&a, number 2.")]),
    ("Ann Lee: Chief Executive Officer\n[Applause]\nab\nCopyright 2024 q&a\nIt was 4, in all.", [("Ann Lee", "ceo", "remarks", "It was 4, in all.")]),
    ("It was 4, in all.\nCy Poe: Analyst", [("unknown", "other", "unknown", "It was 4, in all.")]),
    ("We turn to q&a, number 2.\nAnn Lee: Chief Executive Officer\nIt was 4, in all.", [("unknown", "other", "qa", "We turn to q&a, number 2."), ("Ann Lee", "ceo", "qa", "It was 4, in all.")]),
]


def test_blocks_follow_the_rules(spark):
    rnd = random.Random(5)
    texts = ["\n".join(rnd.choices(LINES, k=rnd.randint(1, 14))) for _ in range(400)]
    raw = spark.createDataFrame([(f"T{i}", "20240101", t) for i, t in enumerate(texts)], "ticker string, date string, raw_text string")
    got: dict[str, list] = {}
    for r in sorted(D.blocks(D.annotated(raw)).collect(), key=lambda r: (r.ticker, r.block)):
        got.setdefault(r.ticker, []).append((r.speaker_name, r.speaker_role, r.section, r.text))
    for i, t in enumerate(texts):
        assert got.get(f"T{i}", []) == stated(t), t


def test_blocks_by_hand(spark):
    raw = spark.createDataFrame([(f"T{i}", "20240101", t) for i, (t, _) in enumerate(BY_HAND)], "ticker string, date string, raw_text string")
    rows = sorted(D.blocks(D.annotated(raw)).collect(), key=lambda r: (r.ticker, r.block))
    for i, (t, want) in enumerate(BY_HAND):
        assert [(r.speaker_name, r.speaker_role, r.section, r.text) for r in rows if r.ticker == f"T{i}"] == want == stated(t), t


def test_sentence_ids_are_dense(spark):
    text = "Ann Lee: Chief Executive Officer\nThis is one long sentence here. This is another long sentence. No.\nCy Poe: Analyst\nThis is the 3rd long sentence, again."
    raw = spark.createDataFrame([("A", "20240101", text), ("B", "20240101", "short"), ("C", "20240101", None)], "ticker string, date string, raw_text string")
    rows = sorted(D.preprocess(raw, least_chars=20).collect(), key=lambda r: r.sentence_id)
    assert [r.sentence_id for r in rows] == [0, 1, 2]
    assert [r.speaker_role for r in rows] == ["ceo", "ceo", "analyst"]
    stats = D.preprocessing_stats(raw, D.preprocess(raw, least_chars=20), least_chars=20).first()
    assert (stats.processed, stats.skipped, stats.failed, stats.sentences) == (1, 2, 0, 3)


def test_plan_has_one_exchange_for_the_windows(spark):
    raw = spark.createDataFrame([("A", "20240101", "x")], "ticker string, date string, raw_text string")
    plan = D.preprocess(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") <= 2
