"""Mixing to target weights with soft domain membership.

A multinomial classifier, trained on a bounded sample of the labelled table (``SAMPLE`` rows), predicts for every
document the posterior of each domain. Document rates r >= ``lower`` are then fitted so that the expected domain totals
``S_d = sum_i r_i * tokens_i * p_id`` match targets ``T_d``, by projected-gradient least squares on
``sum_d (S_d - T_d)^2 / (2 A_dd)`` with ``A = sum_i tokens_i p_i p_i'``. In the metric of the tokens a step is

    r_i <- max(lower, r_i - eta * sum_d p_id * (S_d - T_d) / A_dd)

so a rate is a fold over the steps' D numbers. Each iteration is one aggregation of the stored posteriors; only D totals
reach the driver. The steps reach the aggregation as the value of a scalar subquery, and after ``FOLDED`` of them the
rates are stored beside the posteriors. So all iterations have one short plan, compiled once, and none leaves a broadcast,
its threads and its buffers in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.shared import discard, stored, table

#: Share of tokens each domain shall have. Domains are the languages of the labelled documents.
TARGETS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}
SAMPLE = 4000
HASHED = 4096
LOWER = 1.0
STEPS = 30
FOLDED = 10
TOLERANCE = 1e-4
_SLOTS = 1 << 20


def labelled_sample(documents: DataFrame, labels: DataFrame, domains: list[str], domain: str = "lang") -> DataFrame:
    """Text and class index of at most ``SAMPLE`` labelled documents, the lowest hashes of their ids."""
    chosen = (
        labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("labelled_id")).distinct()
        .orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(SAMPLE)
    )
    index = F.array_position(F.array(*map(F.lit, domains)), F.col(domain)) - 1
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), index.cast("double").alias("label"))
    return (
        named.join(F.broadcast(chosen), named["doc_id"] == chosen["labelled_id"])  # at most SAMPLE numbers
        .where("label >= 0").groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("one")).select("one.label", "one.text")
    )


def words(text: str = "text") -> Column:
    return F.split(text, " ")


@dataclass
class Classifier:
    """Posterior of each domain; without a usable sample every domain is equally likely."""

    domains: list[str]
    model: PipelineModel | None

    def posteriors(self, texts: DataFrame) -> DataFrame:
        """Add ``tokens`` and ``posterior`` (array of double, one per domain) to a frame with a ``text`` column."""
        split = texts.withColumn("words", words())
        tokens = F.when(F.length("text") > 0, F.size("words")).otherwise(0).cast("long")
        if self.model is None:
            flat = F.array(*[F.lit(1.0 / len(self.domains))] * len(self.domains))
            return split.withColumns({"tokens": tokens, "posterior": flat}).drop("words")
        out = self.model.transform(split).withColumns({"tokens": tokens, "posterior": vector_to_array("probability")})
        return out.select(*texts.columns, "tokens", "posterior")


def train(sample: DataFrame, domains: list[str]) -> Classifier:
    """A domain that the sample does not show gets probability zero."""
    sample = stored(sample, "domains")
    if sample.select("label").distinct().count() < 2:
        return Classifier(domains, None)
    # the highest class must occur for the number of classes to be right: a weightless row of every class
    classes = sample.sparkSession.range(len(domains)).select(F.col("id").cast("double").alias("label"), F.lit("").alias("text"), F.lit(1e-9).alias("weight"))
    rows = sample.withColumn("weight", F.lit(1.0)).unionByName(classes).withColumn("words", words()).coalesce(4)
    hashed, unit = HashingTF(inputCol="words", outputCol="hashed", numFeatures=HASHED), Normalizer(p=1.0, inputCol="hashed", outputCol="features")
    ready = unit.transform(hashed.transform(rows)).select("label", "features", "weight")
    fitted = LogisticRegression(maxIter=30, regParam=1e-3, family="multinomial", weightCol="weight").fit(ready)
    return Classifier(domains, PipelineModel([hashed, unit, fitted]))


@dataclass
class Fit:
    """Step vectors (already scaled), and the totals before, wanted and reached."""

    steps: list[list[float]]
    lower: float
    before: list[float]
    target: list[float]
    reached: list[float]

    def rate(self) -> Column:
        value = F.lit(max(1.0, self.lower))
        for step in self.steps:
            move = sum((F.get("posterior", d) * F.lit(g) for d, g in enumerate(step)), F.lit(0.0))
            value = F.greatest(F.lit(self.lower), value - move)
        return value


def stepped(posteriors: DataFrame, steps: list[list[float]], lower: float) -> DataFrame:
    """Add ``rate``, equal to that of a ``Fit`` with these steps; a ``rate`` that is there is taken further by them.

    The steps are filled up with zeros, which move no rate.
    """
    value = F.col("rate") if "rate" in posteriors.columns else F.lit(max(1.0, lower))
    if not steps:
        return posteriors.withColumn("rate", value)
    k, n = len(steps[0]), -(-len(steps) // FOLDED) * FOLDED
    numbers = [float(g) for step in steps for g in step] + [0.0] * (k * (n - len(steps)))
    row = posteriors.sparkSession.sql(f"SELECT * FROM VALUES (array({', '.join(f'{g!r}D' for g in numbers)})) AS t(steps)")
    for i in range(n):
        move = sum((F.get("posterior", d) * F.get("steps", i * k + d) for d in range(k)), F.lit(0.0))
        value = F.greatest(F.lit(lower), value - move)
    return posteriors.withColumn("steps", row.scalar()).withColumn("rate", value).drop("steps")


def fit_rates(stored_posteriors: DataFrame, weights: list[float], lower: float = LOWER, total: float | None = None, steps: int = STEPS) -> Fit:
    """Rates whose expected totals are ``weights`` times ``total`` tokens, for a frame with tokens and posterior.

    Without ``total`` it is the smallest for which no domain must shrink, so that rates of at least 1 can reach it.
    """
    share = [w / sum(weights) for w in weights]
    k = len(share)
    p = [F.get("posterior", d) for d in range(k)]
    tokens = F.col("tokens").cast("double")
    first = stored_posteriors.agg(
        *[F.sum(tokens * p[i] * p[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(tokens * p[d]).alias(f"b{d}") for d in range(k)],
        *[F.sum(F.lit(max(1.0, lower)) * tokens * p[d]).alias(f"s{d}") for d in range(k)],
    ).first()
    a = [[first[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]

    fit = Fit([], lower, [first[f"b{d}"] or 0.0 for d in range(k)], [], [first[f"s{d}"] or 0.0 for d in range(k)])
    total = total or max((s / w for s, w in zip(fit.before, share) if w > 0), default=0.0)
    fit.target = [w * total for w in share]
    diagonal = [a[d][d] for d in range(k)]
    if not sum(diagonal) > 0:
        return fit
    step = 1.0 / max(sum(row) / d for row, d in zip(a, diagonal) if d > 0)  # bounds the largest eigenvalue
    kept, done = stored_posteriors, 0  # the first ``done`` steps are in the rates of ``kept``
    for _ in range(steps):
        gaps = [s - t for s, t in zip(fit.reached, fit.target)]
        if max(map(abs, gaps)) <= TOLERANCE * total:
            break
        if len(fit.steps) - done == FOLDED:
            before, kept = kept, stored(stepped(kept, fit.steps[done:], lower), "rates")
            if done:
                discard(before)
            done += FOLDED
        fit.steps.append([step * g / d if d > 0 else 0.0 for g, d in zip(gaps, diagonal)])
        rated = stepped(kept, fit.steps[done:], lower)
        row = rated.agg(*[F.sum(F.col("rate") * tokens * p[d]).alias(f"s{d}") for d in range(k)]).first()
        fit.reached = [row[f"s{d}"] or 0.0 for d in range(k)]
    if done:
        discard(kept)
    return fit


def _mixture(documents: DataFrame, labels: DataFrame, targets: dict[str, float], lower: float) -> tuple[Classifier, Fit]:
    domains = list(targets)
    classifier = train(labelled_sample(documents, labels, domains), domains)
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    known = stored(classifier.posteriors(texts).select("tokens", "posterior"), "posteriors")
    return classifier, fit_rates(known, list(targets.values()), lower)


def _copies() -> Column:
    """The whole part of the rate, and one more with the probability of the rest, by a hash of the row."""
    chance = F.pmod(F.xxhash64("key", "text"), F.lit(_SLOTS)) / F.lit(float(_SLOTS))
    whole = F.floor("rate")
    return (whole + (chance < F.col("rate") - whole).cast("long")).cast("int")


def mixing(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, lower: float = LOWER) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain (most likely), posterior (in the order of the targets), rate, copies.

    Labelled rows whose domain (``lang``) is not among the targets do not train. NULL and empty texts have no tokens;
    they keep the rate the posterior gives them. Repeated rows get equal rates. Without labels of two domains all
    domains are equally likely. Other columns are ignored. An empty table gives no rows.
    """
    classifier, fit = _mixture(documents, labels, targets, lower)
    texts = documents.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rated = classifier.posteriors(texts).withColumn("rate", fit.rate()).withColumn("copies", _copies())
    likely = F.get(F.array(*map(F.lit, targets)), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    return rated.select(F.col("key").alias("doc_id"), F.col("tokens").alias("n_tokens"), likely.alias("domain"), "posterior", "rate", "copies")


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, lower: float = LOWER) -> DataFrame:
    """The rows of ``documents``, all columns as they are, each as many times as its copies."""
    classifier, fit = _mixture(documents, labels, targets, lower)
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rated = classifier.posteriors(rows).withColumn("rate", fit.rate()).withColumn("copies", _copies())
    return rated.select("row", F.explode_outer(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).where("copy = 1").select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, table(spark, sf_dir, "labels"))
