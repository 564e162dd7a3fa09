"""URL filter: path rules first, then gradient-boosted trees on lexical features.

``lexical_features`` describes a URL by expressions only: lengths, depth,
digit ratio, character entropy, parameter counts and statistics of its host
suffix.  ``fit`` trains MLlib's gradient-boosted trees on labelled URLs (at
most ``MAX_LABELLED`` of them, a hash sample), ``judge`` applies rules and model.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and is judged by the model on its other features; with no labelled
URLs, or labels of one class only, the model's verdict is that class (allow
when there is none); repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
SUFFIX_BUCKETS = 1024  # suffix statistics are kept per hash bucket, which bounds their table
FEATURES = ["url_chars", "host_chars", "path_chars", "depth", "host_labels", "digit_ratio", "entropy", "n_params",
            "n_hyphens", "query_chars", "has_fragment", "has_extension", "suffix_bad_rate", "suffix_share"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) that fits the host or a parent domain and
    begins the path, as struct ``rule, action``; nulls if none fits.  Longer rules are tried first."""
    found = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        r_host, r_path = rule[:cut], rule[cut:]
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,action:string>") if found is None else found


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")),
                         lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def lexical_features(pages: DataFrame) -> DataFrame:
    """Adds ``host``, ``path``, ``suffix`` and the numeric features that need no corpus statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    df = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return (df.withColumn("suffix", F.substring_index("host", ".", -1))
            .withColumn("suffix_bucket", F.pmod(F.xxhash64("suffix"), F.lit(SUFFIX_BUCKETS)))
            .withColumn("url_chars", F.length(url)).withColumn("host_chars", F.length("host"))
            .withColumn("path_chars", F.length("path")).withColumn("depth", _count(F.col("path"), "/"))
            .withColumn("host_labels", F.size(F.split("host", r"\.")))
            .withColumn("digit_ratio", F.when(F.length(url) > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / F.length(url)).otherwise(0.0))
            .withColumn("entropy", entropy(url))
            .withColumn("n_params", F.when(query != "", _count(query, "&") + 1).otherwise(0))
            .withColumn("n_hyphens", _count(url, "-")).withColumn("query_chars", F.length(query))
            .withColumn("has_fragment", F.contains(url, F.lit("#")).cast("int"))
            .withColumn("has_extension", F.rlike(F.col("path"), F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("int")))


def labelled_urls(pages: DataFrame, labels: DataFrame, limit: int | None = MAX_LABELLED) -> DataFrame:
    """``url, bad`` for URLs whose document (the number that ends their path) is
    labelled; bad: low quality or toxic.  At most about ``limit`` rows, chosen by hash; all with None."""
    known = (labels.where(F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("double")).alias("bad")))
    rows = (pages.select("url", F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1).alias("n"))
            .where("n <> ''").select("url", F.col("n").cast("long").alias("doc_id"))
            .join(known.where("bad is not null"), "doc_id").select("url", "bad"))
    if limit is None:
        return rows
    total = rows.count()
    return rows if total <= limit else rows.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1e6 * limit / total))


class UrlModel:
    """Suffix statistics, fitted trees and the verdict where the labels hold one class."""

    def __init__(self, suffixes: DataFrame, trees: PipelineModel | None, base_rate: float):
        self.suffixes, self.trees, self.base_rate = suffixes, trees, base_rate

    def scored(self, pages: DataFrame) -> DataFrame:
        """Adds the features and ``bad_probability``."""
        df = (lexical_features(pages).join(F.broadcast(self.suffixes), "suffix_bucket", "left")
              .fillna({"suffix_bad_rate": self.base_rate, "suffix_share": 0.0}))
        if self.trees is None:
            return df.withColumn("bad_probability", F.lit(self.base_rate))
        return (self.trees.transform(df).withColumn("bad_probability", vector_to_array("probability")[1])
                .drop("features", "rawPrediction", "probability", "prediction"))


def fit(pages: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 4, limit: int = MAX_LABELLED, seed: int = 7) -> UrlModel:
    """Trees on a bounded sample of labelled URLs.  Suffix statistics: the smoothed
    bad rate over all labelled URLs and the share of all URLs, over every page."""
    sample = labelled_urls(pages, labels, limit).persist()
    n, base = sample.agg(F.count(F.lit(1)), F.avg("bad")).first()
    base = float(base or 0.0)
    every = lexical_features(pages.select("url")).groupBy("suffix_bucket").agg(F.count(F.lit(1)).alias("n_all"))
    total = pages.count()
    rated = lexical_features(labelled_urls(pages, labels, None)).groupBy("suffix_bucket").agg(((F.sum("bad") + 10 * base) / (F.count(F.lit(1)) + 10)).alias("suffix_bad_rate"))
    suffixes = every.join(F.broadcast(rated), "suffix_bucket", "left").select(
        "suffix_bucket", F.coalesce("suffix_bad_rate", F.lit(base)).alias("suffix_bad_rate"), (F.col("n_all") / max(total, 1)).alias("suffix_share"))
    if not n or base in (0.0, 1.0):
        sample.unpersist()
        return UrlModel(suffixes, None, base)
    train = UrlModel(suffixes, None, base).scored(sample)
    stages = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    data = stages.transform(train).select("features", "bad").persist()
    boosted = GBTClassifier(labelCol="bad", maxIter=trees, maxDepth=depth, seed=seed, maxBins=32, stepSize=0.2).fit(data)
    data.unpersist()
    sample.unpersist()
    return UrlModel(suffixes, PipelineModel([stages, boosted]), base)


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """Every page with ``host, path, rule, verdict`` and the model's ``bad_probability``."""
    found = matching_rule(F.col("host"), F.col("path"), rules)
    return (model.scored(pages.select("page_id", "url")).withColumn("_r", found)
            .select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                    F.coalesce("_r.action", F.when(F.col("bad_probability") >= threshold, "block").otherwise("allow")).alias("verdict"),
                    "bad_probability"))
