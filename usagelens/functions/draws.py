"""Resampling as JVM expressions: counter-based uniforms and inverse distribution functions.

The uniform number of a key and a replicate comes from 52 bits of an MD5 digest. It depends on nothing else, so results
are the same on any partitioning and in any engine. A distribution is a table of steps (k, cdf) around its mean, as wide
as ten standard deviations and 20 more: the mass beyond is below the resolution of the uniforms. A group has of the order
of the square root of its size in steps, whatever the number of rows that were counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import dbl

DIGITS = 13  # hexadecimal digits of the digest: 52 bits
SPREADS, EXTRA = 10, 20


def uniform(*key: Column | str) -> Column:
    """A number in (0, 1) that depends on the key's text alone."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** (4 * DIGITS))


def _steps(frame: DataFrame, keys: Sequence[str], low: Column, high: Column, log_ratio: Column) -> DataFrame:
    """Rows (frame's columns, k, cdf); ``log_ratio`` is ln(P(k) / P(k - 1)) and may use the column ``k``."""
    group, rising = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = frame.withColumn("_low", low.cast("long")).withColumn("k", F.explode(F.sequence("_low", high.cast("long"))))
    height = F.sum(F.when(F.col("k") == F.col("_low"), 0.0).otherwise(log_ratio)).over(rising)
    mass = F.exp(F.col("_height") - F.max("_height").over(group))
    return (
        steps.withColumn("_height", height)
        .withColumn("_mass", mass)
        .withColumn("cdf", F.sum("_mass").over(rising) / F.sum("_mass").over(group))
        .drop("_height", "_mass")
    )


def binomial_steps(counts: DataFrame, keys: Sequence[str], n: str, successes: str) -> DataFrame:
    """Steps of the number of successes in n draws from a group with these counts."""
    size, ok = dbl(n), dbl(successes)
    spread = SPREADS * F.sqrt(ok * (size - ok) / size)
    one_way = (ok == 0) | (ok == size)
    low = F.when(one_way, ok).otherwise(F.greatest(F.lit(0.0), F.floor(ok - spread)))
    high = F.when(one_way, ok).otherwise(F.least(size, F.ceil(ok + spread + EXTRA)))
    odds = F.try_divide(ok, size - ok)
    return _steps(counts, keys, low, high, F.ln((size - F.col("k") + 1) / F.col("k") * odds))


def poisson_steps(counts: DataFrame, keys: Sequence[str], mean: str) -> DataFrame:
    """Steps of a Poisson number with the given mean above 0."""
    c = dbl(mean)
    spread = SPREADS * F.sqrt(c)
    low, high = F.greatest(F.lit(0.0), F.floor(c - spread)), F.ceil(c + spread + EXTRA)
    return _steps(counts, keys, low, high, F.ln(c / F.col("k")))


def _sorted_uniforms(keys: Sequence[str], replicates: int) -> Column:
    return F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: uniform(*keys, r)))


def binomial_interval(
    counts: DataFrame, keys: Sequence[str], n: str, successes: str, replicates: int, quantiles: Sequence[float] = (0.025, 0.975)
) -> DataFrame:
    """Rows (keys, ci_low, ci_high): interpolated quantiles of the resampled success rates of each group.

    A draw rises with its uniform number, so the quantiles of the draws are the draws of the uniforms in those places:
    only they are looked up.
    """
    places = [(int(q * (replicates - 1)), q * (replicates - 1) % 1) for q in quantiles]
    wanted = [i for p, _ in places for i in (p, min(p + 1, replicates - 1))]
    drawn = counts.select(*keys, n, successes).withColumn("_u", _sorted_uniforms(keys, replicates))
    drawn = drawn.withColumn("_u", F.array(*[F.element_at("_u", i + 1) for i in wanted]))
    at = [(F.min("_low") + F.count_if(F.col("cdf") < F.col("_u")[j])).alias(f"_k{j}") for j in range(len(wanted))]
    found = binomial_steps(drawn, keys, n, successes).groupBy(*keys, n).agg(*at)

    def between(j: int) -> Column:
        low, high = dbl(f"_k{2 * j}") / dbl(n), dbl(f"_k{2 * j + 1}") / dbl(n)
        return low + (high - low) * places[j][1]

    return found.select(*keys, between(0).alias("ci_low"), between(1).alias("ci_high"))


def poisson_draws(counts: DataFrame, keys: Sequence[str], mean: str, replicates: int) -> DataFrame:
    """Rows (keys, replicate, w): a Poisson number with the group's mean for every replicate.

    Steps and uniforms of a group are sorted together, and every uniform takes the last step that begins below it.
    """
    steps = poisson_steps(counts.select(*keys, mean), keys, mean)
    begin = F.lag("cdf", 1, -1.0).over(W.partitionBy(*keys).orderBy("k"))
    steps = steps.select(*keys, begin.alias("x"), "k", F.lit(None).cast("int").alias("replicate"))
    drawn = counts.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.select(*keys, uniform(*keys, "replicate").alias("x"), F.lit(None).cast("long").alias("k"), "replicate")
    # at equal x the uniform comes first: a step holds above its beginning
    order = W.partitionBy(*keys).orderBy("x", F.col("k").isNotNull(), "k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        steps.unionByName(drawn)
        .withColumn("w", F.last("k", ignorenulls=True).over(order))
        .where("replicate IS NOT NULL")
        .select(*keys, "replicate", "w")
    )
