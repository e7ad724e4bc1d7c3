"""URL filter: longest-match rules, gradient-boosted trees for the rest.

Only DataFrame functions and MLlib's tree boosting run here; a page costs
one pass and a join with each table of rates.  The trees learn from the URLs
that a rule decides, on lexical features: length, depth, digit ratio, character
entropy, parameter counts and smoothed block rates of the host's suffixes and
of the first path segment.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged by the trees like any other string.  Equal URLs get
equal verdicts; repeated rows stay.  Without labelled URLs, or with labels of
one kind only, the other pages get that kind (``allow`` without any label).
Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, unit_hash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBERS = ["length", "depth", "digit_ratio", "entropy", "n_params", "host_labels", "path_length", "has_fragment"]
RATES = ["tld_rate", "domain_rate", "segment_rate"]
SMOOTH = 20.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
    lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """``host/path`` into the host and the path with its slash."""
    host, slash, rest = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + rest


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits: the host or a parent domain of it, and a
    prefix of the path (ties: the later in code-point order); else null."""
    fits = []
    for rule in sorted((r for _, r in rules), key=lambda r: (len(r), r), reverse=True):
        h, p = split_rule(rule)
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def keyed(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host``, ``path`` and the keys of a URL."""
    return df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumns({
        "tld": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
        "segment": F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")),
    })


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host``, ``path`` and the numbers and keys of a URL."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return keyed(df, url).withColumns({
        "length": F.log1p(n.cast("double")),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "digit_ratio": F.when(n == 0, 0.0).otherwise((n - F.length(F.translate(u, "0123456789", ""))) / n),
        "entropy": F.when(n == 0, 0.0).otherwise(entropy),
        "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "host_labels": F.when(F.col("host") == "", 0.0).otherwise(F.size(labels).cast("double")),
        "path_length": F.log1p(F.length("path").cast("double")),
        "has_fragment": u.contains("#").cast("double"),
    })


def _rates(cells: DataFrame, key: str, rate: str, prior: float) -> DataFrame:
    """Smoothed block rate of each key over all labelled rows."""
    return cells.groupBy(key).agg(((F.sum("blocks") + prior * SMOOTH) / (F.sum("n") + SMOOTH)).alias(rate))


@dataclass
class UrlModel:
    rates: dict[str, DataFrame]
    prior: float
    trees: GBTClassificationModel | None


def _featured(df: DataFrame, rates: dict[str, DataFrame], prior: float) -> DataFrame:
    for key, rate in zip(("tld", "domain", "segment"), RATES, strict=True):
        df = df.join(rates[key], key, "left").fillna(prior, [rate])
    return VectorAssembler(inputCols=NUMBERS + RATES, outputCol="features").transform(df)


def labelled(df: DataFrame, url: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``url`` and ``blocked`` (1 or 0) of every row that a rule decides."""
    block = [r for a, r in rules if a == "block"]
    rows = df.select(F.col(url).alias("url"))
    rows = rows.withColumn("_rule", matched_rule(host_of(F.col("url")), path_of(F.col("url")), rules)).where(F.col("_rule").isNotNull())
    return rows.select("url", F.col("_rule").isin(block).cast("double").alias("blocked"))


def sample_of(known: DataFrame, urls: dict[float, int], max_sample: int, seed: int) -> DataFrame:
    """At most ``max_sample`` distinct rows of ``known``, the lowest by the
    hash of the URL: as many of each kind, and more of one where the other has
    no more.  ``urls``: about how many distinct URLs each kind has."""
    place = unit_hash("url", seed=seed)
    # The estimate bounds what is ranked; a fifth more is ten times its error.
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in urls.items() for x in (k, 1.2 * max_sample / n)]), F.col("blocked"))
    some = known.where(place < share).distinct()
    nth = F.row_number().over(Window.partitionBy("blocked").orderBy(place, "url"))
    return some.withColumn("_nth", nth).orderBy("_nth", "blocked").limit(max_sample).drop("_nth")


def fit(df: DataFrame, url: str, rules: list[tuple[str, str]], max_sample: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7) -> UrlModel:
    """Learn from the URLs that a rule decides.  Every row is labelled, and
    the rates count all labelled rows; only the trees are fitted on at most
    ``max_sample`` distinct labelled URLs, weighted so that both kinds count as
    in the whole table."""
    known = labelled(df, url, rules)
    kinds = known.groupBy("blocked").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("url", 0.02).alias("urls")).collect()  # two rows at most
    n, urls = {r["blocked"]: r["n"] for r in kinds}, {r["blocked"]: max(r["urls"], 1) for r in kinds}
    prior = n.get(1.0, 0) / max(sum(n.values()), 1)
    sample = save(lexical(sample_of(known, urls, max_sample, seed) if urls else known, "url").drop("url"))
    cells = save(keyed(known, "url").groupBy("tld", "domain", "segment").agg(F.sum("blocked").alias("blocks"), F.count(F.lit(1)).alias("n")))
    rates = {key: save(_rates(cells, key, rate, prior)) for key, rate in zip(("tld", "domain", "segment"), RATES, strict=True)}
    if len(n) < 2:
        return UrlModel(rates, prior, None)
    taken = {r["blocked"]: r["count"] for r in sample.groupBy("blocked").count().collect()}
    weight = F.when(F.col("blocked") == 1, urls[1.0] / taken[1.0]).otherwise(urls[0.0] / taken[0.0])
    rows = _featured(sample, rates, prior).select("features", "blocked", weight.alias("weight"))
    gbt = GBTClassifier(featuresCol="features", labelCol="blocked", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, cacheNodeIds=False)
    return UrlModel(rates, prior, gbt.fit(rows))


def predict(df: DataFrame, url: str, model: UrlModel) -> DataFrame:
    """``df`` with ``host``, ``path`` and ``block_score`` (0 to 1)."""
    keep = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(url).alias("_url"))
    feats = _featured(lexical(keep, "_url"), model.rates, model.prior)
    if model.trees is None:
        scored = feats.withColumn("block_score", F.lit(model.prior))
    else:
        scored = model.trees.transform(feats).withColumn("block_score", vector_to_array("probability")[1])
    return scored.select("_row", "host", "path", "block_score")


def filter_urls(df: DataFrame, url: str, rules: list[tuple[str, str]], **fit_options) -> DataFrame:
    """One row for each row of ``df``: its columns as ``_row``, ``host``,
    ``path``, ``rule``, ``verdict`` and ``block_score``."""
    action = F.create_map(*chain.from_iterable((F.lit(r), F.lit(a)) for a, r in rules)) if rules else None
    out = predict(df, url, fit(df, url, rules, **fit_options)).withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    by_trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    verdict = F.coalesce(F.element_at(action, F.col("rule")), by_trees) if rules else by_trees
    return out.withColumn("verdict", verdict)


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def query(spark, sf_dir):
    """Every page's host, path, rule and verdict."""
    from .common import read_table

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, "url", RULES).select("_row.page_id", "host", "path", "rule", "verdict", "block_score")
