"""URL filter: host and path rules, and gradient-boosted trees where no rule fits.

The trees see lexical features only: lengths, depth, digit and symbol counts, digit ratio, entropy, parameter counts and
smoothed block rates of the top-level domain, the first path segment and the file suffix. They are trained on URLs that
a rule labels (a bounded sample, ``SAMPLE`` rows in expectation, chosen by the URL's hash and de-duplicated); the block
rates count all labelled URLs.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.shared import stored, table

# Fixed values: (rule, verdict); a rule is host/path.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

SAMPLE = 20_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 7
SMOOTHING = 20.0
SLOTS = 1_000_000

_PARTS = r"(?s)\A.*?://([^/?#]*+)([^?#]*+)"
SUFFIXES = ["tld", "segment", "extension"]
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "hyphens", "symbols", "parameters",
    "fragment", "entropy", *(f"{s}_rate" for s in SUFFIXES),
]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url (NULL: empty), host and path."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.regexp_extract(url, _PARTS, 2).alias("path")
    )


def matching_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; NULL where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last one set, the longest, wins
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _count(text: str, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(F.col(text), characters, ""))).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """Features that need nothing but the URL, and the suffix keys."""
    n = F.greatest(F.length("url"), F.lit(1)).cast("double")
    each = F.array_distinct(F.split("url", ""))

    def term(total: Column, c: Column) -> Column:
        share = (F.length("url") - F.length(F.replace(F.col("url"), c, F.lit("")))) / n
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return urls.select(
        "*",
        F.length("url").cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"), _count("path", "/").alias("depth"), _count("host", ".").alias("labels"),
        _count("url", string.digits).alias("digits"), (_count("url", string.digits) / n).alias("digit_ratio"),
        _count("url", "-").alias("hyphens"), _count("url", "%_~+!$,;@").alias("symbols"), _count("url", "=").alias("parameters"),
        F.contains("url", F.lit("#")).cast("double").alias("fragment"), F.aggregate(each, F.lit(0.0), term).alias("entropy"),
        F.substring_index("host", ".", -1).alias("tld"), F.regexp_extract("path", r"\A/([^/]*+)/", 1).alias("segment"),
        F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})\z", 1).alias("extension"),
    )


def with_rates(urls: DataFrame, labelled: DataFrame, prior: float) -> DataFrame:
    """Add the smoothed share of blocked URLs of each suffix; ``prior`` for suffixes without labels."""
    for suffix in SUFFIXES:
        rates = labelled.groupBy(F.col(suffix).alias("key")).agg(
            ((F.sum("label") + F.lit(SMOOTHING * prior)) / (F.count(F.lit(1)) + F.lit(SMOOTHING))).alias("rate")
        )
        rates = stored(rates, "rates")  # its size on disk decides whether it is broadcast
        urls = urls.join(rates, urls[suffix] == rates["key"], "left").withColumn(f"{suffix}_rate", F.coalesce("rate", F.lit(prior))).drop("key", "rate")
    return urls


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, block_score (NULL where a rule decides).

    A NULL URL or one without ``://`` has an empty host and path and fits no rule; the trees judge it by its features.
    If the labelled URLs are all of one kind, or there are none, the score is their share of blocks (0 without any).
    Repeated rows are judged alike. Other columns are ignored. An empty table gives no rows.
    """
    rule, verdict = matching_rule(rules)
    urls = stored(
        lexical(parsed(pages)).withColumns({"rule": rule, "says": verdict}).withColumn("label", (F.col("says") == "block").cast("double")), "urls"
    )
    labelled = urls.where("rule IS NOT NULL")
    counts = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = counts["n"], counts["blocked"] or 0.0
    prior = blocked / n if n else 0.0
    if 0 < blocked < n:
        featured = with_rates(urls, labelled, prior)
        drawn = F.pmod(F.xxhash64("url"), F.lit(SLOTS)) < F.lit(max(1, int(SLOTS * min(1.0, SAMPLE / n))))
        sample = stored(featured.where("rule IS NOT NULL").where(drawn).select("url", "label", *FEATURES).distinct(), "labelled")
        kinds = {r["label"] for r in sample.select("label").distinct().collect()}
    else:
        kinds = set()
    if len(kinds) == 2:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, featuresCol="features", labelCol="label")
        model = trees.fit(vectors.transform(sample).select("features", "label").coalesce(4))
        scored = model.transform(vectors.transform(featured)).withColumn("score", _second("probability"))
    else:
        scored = urls.withColumn("score", F.lit(prior))
    by_method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("says", by_method).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("block_score"),
    )


def _second(vector: str) -> Column:
    return F.get(vector_to_array(vector), 1)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
