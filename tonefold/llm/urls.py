"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for what no rule decides.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path is what follows up to `?`, `#` or the end. A rule
(action, `host/path`) fits its host and all subdomains where the URL's path starts with the rule's; the longest rule wins, of rules of one length the one with the
longer host, of two actions for one rule block. Where no rule fits, a classifier decides: character n-grams of host and path, hashed into a fixed number of features and
scaled to length 1, weighted by a logistic regression that is trained on a small table of labelled URLs.

Rules and scores are expressions of a row: pages aren't shuffled, so a host with a third of all rows is no hot key. More rules than MOST_LITERAL are a table that is
joined to the distinct hosts.

A null URL, and one without `://`, has an empty host and an empty path: no rule fits, and its score is the model's intercept. URLs may be of any length. A score that equals the
limit blocks. Repeated rows get a row each; a null page_id is carried along; other columns, whatever their names, are ignored. An empty table gives an empty table.
Labelled rows without a URL or a label are left out; without rows of both labels there is nothing to learn: ValueError.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of n-grams; number of features (the weights that go to every executor: 8 bytes each).
GRAMS, FEATURES = (3, 4, 5), 1 << 18
#: Labelled URLs that the classifier learns from, at most; a larger table is sampled by a hash of its URLs.
MOST_LABELLED = 20_000
#: Rules that go into expressions; more become a table.
MOST_LITERAL = 1_000
#: The rules that the query applies, and the names from which its labelled URLs are put together.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BAD_NAMES = (
    "casino-bonus", "online-casino", "win-cash-now", "lucky-win", "cheap-meds", "cheap-watches", "pills-shop", "diet-pills", "spam-links", "spammy-mail",
    "link-farm", "content-farm", "ads-server", "pop-ads", "click-track", "ad-tracker", "free-prize", "payday-loans", "crack-warez", "adult-cams",
)
GOOD_NAMES = (
    "city-library", "weather-report", "daily-herald", "physics-institute", "cooking-notes", "garden-club", "open-archive", "history-museum", "science-journal", "public-radio",
    "mountain-hiking", "language-school", "health-ministry", "transport-authority", "chess-federation", "music-theory", "software-docs", "bird-watching", "river-trust", "school-district",
    "the-other-side", "nation-today", "thinker", "northern-theatre", "mathematics", "translation", "education", "athletics", "ethics-board", "thirty-three",
    "station-house", "motion-lab", "weather-station", "them-and-us", "threads", "another-thing", "therapy-rooms", "tradition", "information-desk", "there-and-here",
)

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), *_LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block): BAD_NAMES and GOOD_NAMES as hosts, with prefixes, domains and paths that say nothing about the label."""
    ends = [("https://", "com", "/en/12"), ("http://www.", "org", "/de/7.html"), ("https://blog.", "net", "/fr/305/"), ("http://m.", "com", "/es/48")]
    rows = [(f"{a}{name}.example.{b}{c}", label) for names, label in ((BAD_NAMES, 1), (GOOD_NAMES, 0)) for name, (a, b, c) in product(names, ends)]
    return spark.createDataFrame(rows, "url string, label int")


def grams(rows: DataFrame, at: str = "grams") -> DataFrame:
    """rows (host, path) with the character n-grams of both, between marks for their ends; h or p tells where they stand. In time proportional to the URL."""
    names = []
    for c in ("host", "path"):
        rows = rows.withColumn(f"_{c}", F.split(F.concat(F.lit("^"), c, F.lit("$")), ""))
        for n in GRAMS:
            names.append((c[0], f"_{c}{n}"))
            rows = NGram(n=n, inputCol=f"_{c}", outputCol=f"_{c}{n}").transform(rows)

    def marked(mark: str, name: str) -> Column:
        return F.transform(name, lambda g: F.concat(F.lit(mark), g))

    return rows.withColumn(at, F.concat(*[marked(*x) for x in names])).drop("_host", "_path", *[name for _, name in names])


def features(rows: DataFrame, at: str = "features") -> DataFrame:
    """rows (host, path) with their hashed n-grams as a vector of length 1 (of length 0 without any)."""
    counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_counts").transform(grams(rows, "_grams"))
    return Normalizer(inputCol="_counts", outputCol=at).transform(counted).drop("_grams", "_counts")


def trained(labelled: DataFrame, most: int = MOST_LABELLED) -> LogisticRegressionModel:
    """labelled: url, label (0 or 1). Learns from at most `most` rows: one partition, in one order, so that a table always gives the same weights."""
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).where("url is not null and label in (0, 1)")
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most)
    if rows.select("label").distinct().count() < 2:
        raise ValueError("labelled URLs of both labels are needed")
    known = features(rows.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label").coalesce(1))
    return LogisticRegression(maxIter=200, regParam=1e-4, standardization=False, tol=1e-9).fit(known)


def _ranked(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """host, path, rule, action of each rule once, the winning ones first."""
    held: dict[str, str] = {}
    for action, rule in rules:
        name = rule.split("/", 1)[0]
        if action not in ("allow", "block") or "/" not in rule or not name or name != name.translate(str.maketrans(*_LOWER)):
            raise ValueError(f"no rule: {action} {rule}")
        held[rule] = "block" if "block" in (action, held.get(rule)) else "allow"
    rows = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, a) for r, a in held.items()]
    return sorted(rows, key=lambda x: (-len(x[2]), -len(x[0]), x[2]))


def _domains(host: Column, longest: int) -> Column:
    """The host and the domains that it belongs to, as far as they have at most `longest` characters."""
    end = F.when(F.length(host) > longest, F.substring(host, -(longest + 1), longest + 1)).otherwise(host)
    labels = F.split(end, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(every, lambda d: (F.length(d) <= longest) & (d != ""))


def _first(domains: Column, path: Column, ranked: list[tuple[str, str, str, str]]) -> Column:
    """rule and action of the first rule that fits; null without one."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for h, p, rule, action in reversed(ranked):
        out = F.when(F.array_contains(domains, h) & F.startswith(path, F.lit(p)), F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def ruled(rows: DataFrame, rules: list[tuple[str, str]], literal: int = MOST_LITERAL) -> DataFrame:
    """rows (host, path and others) with rule and action of the rule that decides, null where none fits."""
    ranked = _ranked(rules)
    if not ranked:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))
    longest = max(len(r[0]) for r in ranked)
    if len(ranked) <= literal:
        held: dict[str, list] = {}
        for r in ranked:
            held.setdefault(r[0], []).append(r)
        known = rows.withColumn("_domains", F.filter(_domains(F.col("host"), longest), lambda d: d.isin(sorted(held))))
        known = known.withColumn("_hit", F.when(F.size("_domains") > 0, _first(F.col("_domains"), F.col("path"), ranked)))
        return known.select(*rows.columns, "_hit.rule", "_hit.action")
    table = rows.sparkSession.createDataFrame([(h, i, p, r, a) for i, (h, p, r, a) in enumerate(ranked)], "_domain string, _rank long, _path string, _rule string, _action string")
    # paths are compared by host and path, each once: a host with very many pages is one row for each of its paths
    urls = rows.select("host", "path").distinct().withColumn("_domain", F.explode(_domains(F.col("host"), longest)))
    fits = urls.join(table, "_domain").where(F.startswith("path", F.col("_path")))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct(F.col("_rule").alias("rule"), F.col("_action").alias("action")), "_rank").alias("_hit"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, "_hit.rule", "_hit.action")


def judged(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: DataFrame | None = None, limit: float = 0.5, literal: int = MOST_LITERAL) -> DataFrame:
    """pages: page_id, url. Returns page_id, host, path, rule (null where none fits), verdict (allow or block), score (0 to 1, higher: block likelier) of every row."""
    spark = pages.sparkSession
    model = trained(labelled_urls(spark) if labelled is None else labelled)
    url = F.col("url").cast("string")
    rows = ruled(pages.select("page_id", host(url).alias("host"), path(url).alias("path")), RULES if rules is None else rules, literal)
    scored = model.transform(features(rows))
    scored = scored.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("action", F.when(F.col("score") >= limit, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
