"""URL rules against the definition, and what the classifier makes of names that it hasn't seen."""

import random
import re

import numpy as np
import pytest

from tonefold.llm import urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "page_id long, url string, html string, host int, rule int, features string, score string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOW), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def ruled(host, path, rules):
    fits = []
    for action, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), action == "block", rule, action))
    return max(fits)[3:] if fits else (None, None)


AWKWARD = [
    None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET", "http://Example.NET/en/x?y#z", "https://a.b.example.com/de/", "https://example.com/de", "https://xexample.com/de/1",
    "ftp://sub.ORG/fr/", "x://org/fr/?", "http://net/", "http://net?x=/", "http://net#/", "http://notnet/", "http://a.net:80/", "http://user@a.net/p", "a://b://c.net/x", "http://.net/", "http://..org/fr/..",
    "http://" + "sub." * 20_000 + "example.net/en/" + "p" * 50_000, "http://ÉCOLE.net/é", "http://two\nlines.net/a\nb",
]


@pytest.mark.parametrize("literal", [urls.MOST_LITERAL, 0])
def test_rules(spark, literal):
    rnd = random.Random(4)
    made = [f"{rnd.choice(['http', 'https'])}://{rnd.choice(['', 'www.', 'a.b.'])}{rnd.choice(['example', 'EXAMPLE', 'other'])}.{rnd.choice(['net', 'com', 'org'])}{rnd.choice(['', '/'])}{rnd.choice(['en/1', 'de/', 'fr/x', ''])}{rnd.choice(['', '?q', '#t'])}" for _ in range(200)]
    rows = list(enumerate([*made, *AWKWARD, made[0]])) + [(0, made[0]), (None, made[1])]
    rules = [*urls.RULES, ("block", "www.example.org/"), ("allow", "example.org/fr/"), ("allow", "a.b.other.com/de/"), ("block", "a.b.other.com/de/")]
    df = spark.createDataFrame([(i, u, "<p>", 1, 2, "f", "s") for i, u in rows], SCHEMA)
    got = urls.judged(df, rules, literal=literal)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    found = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got.collect()), key=repr)
    assert found == sorted(((i, *split(u), *ruled(*split(u), rules)) for i, u in rows), key=repr)
    assert {r.verdict == ("block" if r.score >= 0.5 else "allow") for r in got.where("rule is null").collect()} == {True}


def test_no_rules_and_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(none).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert [r.rule for r in urls.judged(one, []).collect()] == [None, None]
    with pytest.raises(ValueError):
        urls.judged(one, labelled=spark.createDataFrame([("http://a.com/", 1), (None, 0)], "url string, label int"))
    with pytest.raises(ValueError):
        urls.judged(one, [("block", "Upper.net/")])


def test_the_classifier_judges_names_it_has_not_seen(spark):
    bad = ["casino-royal", "mega-casino", "pills-online", "cheap-pills", "spam-farm", "casino-win", "ads-track", "track-clicks", "link-spam"]
    good = ["ththre", "tiontion", "river-museum", "city-archive", "weather-club", "therheon", "physics-school", "ththing"]
    rows = [(k, f"https://{p}{n}.example.com/en/{i}") for k, names in ((1, bad), (0, good)) for i, n in enumerate(names) for p in ("", "www.", "m.", "blog.")]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), []).collect()
    right = [(r.verdict == "block") == bool(r.page_id) for r in got]
    assert sum(right) >= 0.95 * len(right)


def test_scores_are_those_of_the_definition(spark):
    """The weights minimise the regularised log loss over hashed n-grams: at a minimum the gradient is 0, and scores follow from weights."""
    model = urls.trained(urls.labelled_urls(spark))
    rows = urls.labelled_urls(spark).collect()
    known = urls.features(spark.createDataFrame([(*split(r.url), r.label) for r in rows], "host string, path string, label int")).collect()
    x = np.array([r.features.toArray() for r in known])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    y, w = np.array([r.label for r in known]), model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.abs(x.T @ (p - y) / len(y) + 1e-4 * w).max() < 1e-5 and abs((p - y).mean()) < 1e-5
    got = {(r.host, r.path): r.score for r in urls.judged(spark.createDataFrame([(1, r.url) for r in rows], "page_id long, url string")).collect()}
    assert np.allclose([got[r.host, r.path] for r in known], p)
    made = urls.grams(spark.createDataFrame([("ab.c", "/é🙂")], "host string, path string")).first().grams
    assert sorted(made) == sorted([m + " ".join(t[i : i + n]) for m, t in (("h", "^ab.c$"), ("p", "^/é🙂$")) for n in urls.GRAMS for i in range(len(t) - n + 1)])
