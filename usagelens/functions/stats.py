"""Statistics as column expressions inside the JVM."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import dbl, ratio, scalar

Z_95 = NormalDist().inv_cdf(0.975)
Z_POWER_80 = NormalDist().inv_cdf(0.80)
WILSON_Z = 1.959963985  # fixed value: the rounded quantile of the benchmark report
_SERIES_TERMS = 150
_FRACTION_DEPTH = 120
_SERIES_LIMIT = 8.0  # beyond it the normal CDF is 0 or 1 within 1e-15


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF: 1/2 + pdf(x) * sum of x^(2i+1) / (1*3*...*(2i+1)), inside the JVM."""
    z = F.greatest(F.least(dbl(x), F.lit(_SERIES_LIMIT)), F.lit(-_SERIES_LIMIT))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * z * z / (2 * i + 1)).alias("term"),
            (acc["total"] + acc["term"] * z * z / (2 * i + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    # aggregate() returns NULL only for a NULL input list, so guard the NULL argument here
    return F.when(x.isNotNull(), F.lit(0.5) + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series)


def two_sided_p(z: Column) -> Column:
    return F.greatest(F.lit(0.0), 2 * (1 - normal_cdf(F.abs(z))))


def wilson_bounds(successes: Column | str, n: Column | str, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson score interval, clipped to [0, 1]; (0, 0) for n = 0."""
    k, n = dbl(successes), dbl(n)
    p = F.try_divide(k, n)
    z2 = z * z
    centre = p + F.try_divide(F.lit(z2), 2 * n)
    spread = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z2), 4 * n), n))
    scale = 1 + F.try_divide(F.lit(z2), n)
    low = F.greatest(F.lit(0.0), F.try_divide(centre - spread, scale))
    high = F.least(F.lit(1.0), F.try_divide(centre + spread, scale))
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 0.0).otherwise(high)


def format_p(p: Column | str) -> Column:
    """'p<0.001' below that threshold, else three decimals."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, "p<0.001").otherwise(F.format_string("p=%.3f", p))


# -- tails of distributions, as folds ---------------------------------------------------


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 with full relative precision: the series near 0, else the continued fraction of Laplace."""
    depth = F.sequence(F.lit(_FRACTION_DEPTH), F.lit(1), F.lit(-1))
    fraction = F.aggregate(depth, dbl(z), lambda below, j: z + j / below)
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z < 3, 1 - normal_cdf(z)).otherwise(density / fraction)


def _log_sum(terms: Column, first: Column, step) -> Column:
    """ln of the sum of positive terms, given ln of the first and ``step(i)``, ln of the ratio of the i-th to the one before."""
    more = F.aggregate(
        terms,
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] + step(i)).alias("term"),
            (
                F.greatest(acc["total"], acc["term"] + step(i))
                + F.log1p(F.exp(-F.abs(acc["total"] - acc["term"] - step(i))))
            ).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(F.size(terms) == 0, first).otherwise(more)


def _count_to(last: Column) -> Column:
    """[1, ..., last], empty below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """P(X > statistic) for whole degrees of freedom: a finite sum, in logarithms so that nothing overflows.

    Even: exp(-x/2) (1 + x/2 + (x/2)^2 / 2! + ...), dof / 2 terms. Odd: the normal tail of sqrt(x), twice, and
    2 pdf(sqrt(x)) (x^(1/2) + x^(3/2) / 3 + x^(5/2) / 15 + ...), (dof - 1) / 2 terms. No degree or x <= 0 give 1.
    """
    x, k = dbl(statistic), dof.cast("int")
    log_half = F.ln(x / 2)
    even = F.exp(_log_sum(_count_to(F.floor(k / 2).cast("int") - 1), F.lit(0.0), lambda j: log_half - F.ln(j)) - x / 2)
    terms = F.floor((k - 1) / 2).cast("int")
    series = _log_sum(_count_to(terms - 1), F.ln(x) / 2, lambda j: F.ln(x) - F.ln(2 * j + 1))
    rest = F.when(terms >= 1, F.exp(series + math.log(2) - x / 2 - 0.5 * math.log(2 * math.pi))).otherwise(0.0)
    odd = 2 * normal_tail(F.sqrt(x)) + rest
    known = x.isNotNull() & dof.isNotNull()
    return F.when(known, F.when((x <= 0) | (k <= 0), 1.0).when(k % 2 == 0, even).otherwise(odd))


def _log_gamma_step(a: Column) -> Column:
    """ln of Gamma(a + 1/2) / Gamma(a): its asymptotic series 60 steps up, and the recurrence back."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(59)), F.lit(0.0), lambda total, i: total + F.ln((a + i) / (a + i + 0.5)))
    r = 1 / (a + 60)
    series = 1 - r / 8 * (1 - r / 16 * (1 + r * 5 / 8 * (1 - r * 21 / 160 * (1 + r * 19 / 8))))
    return up + F.ln(a + 60) / 2 + F.ln(series)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function by Lentz' method; it settles within a few sqrt(a + b) steps."""

    def safe(value: Column) -> Column:
        return F.when(F.abs(value) < 1e-300, 1e-300).otherwise(value)

    def step(acc: Column, i: Column) -> Column:
        m = F.floor(i / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        part = F.when(i % 2 == 0, even).otherwise(odd)
        d, c = 1 / safe(1 + part * acc["d"]), safe(1 + part / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    start = F.struct(F.lit(1e300).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))
    steps = F.sequence(F.lit(1), (200 + 8 * F.ceil(F.sqrt(a + b))).cast("int"))
    return F.aggregate(steps, start, step, lambda acc: acc["h"])


def student_t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|): the regularised incomplete beta function at dof / (dof + t^2) with (dof / 2, 1 / 2)."""
    a, half, square = dbl(dof) / 2, F.lit(0.5), dbl(t) * dbl(t)
    log_x, log_y = -F.log1p(square / dbl(dof)), F.ln(square / (dbl(dof) + square))
    front = F.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) + a * log_x + half * log_y)
    x, y = dbl(dof) / (dbl(dof) + square), square / (dbl(dof) + square)
    direct = front / a * _beta_fraction(a, half, x)
    other = 1 - front / half * _beta_fraction(half, a, y)
    share = F.when(square == 0, 1.0).when(x > (a + 1) / (a + 2.5), other).otherwise(direct)
    return F.when(t.isNotNull() & (dof > 0), share)


# -- frame-level statistics ------------------------------------------------------------


def chi_square_statistic(frame: DataFrame, row: str, column: str) -> DataFrame:
    """One row: Pearson statistic, dof, Cramer's V and n from the contingency counts.

    Cells absent from the data count as observed 0. With one degree of freedom the
    absolute deviation is reduced by min(0.5, deviation), as in the continuity correction.
    Rows where either label is NULL are left out. After the count the frame is
    (#row labels x #column labels) rows.
    """
    counted = (
        frame.where(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(F.col(row).alias("r"), F.col(column).alias("c"))
        .agg(F.count(F.lit(1)).alias("o"))
    )
    sizes = counted.agg(
        F.sum("o").alias("n"), F.count_distinct("r").cast("int").alias("rows"), F.count_distinct("c").cast("int").alias("cols")
    )
    cells = (
        counted.withColumn("rt", F.sum("o").over(W.partitionBy("r")))
        .withColumn("ct", F.sum("o").over(W.partitionBy("c")))
        .withColumns({c: scalar(sizes, c) for c in ("n", "rows", "cols")})
        .withColumn("dof", (F.col("rows") - 1) * (F.col("cols") - 1))
        .withColumn("e", dbl("rt") * dbl("ct") / dbl("n"))
    )
    gap = F.abs(dbl("o") - F.col("e"))
    one_dof = F.col("dof") == 1
    shrunk = gap - F.when(one_dof, F.least(F.lit(0.5), gap)).otherwise(0.0)
    summed = cells.agg(
        F.sum(shrunk * shrunk / F.col("e")).alias("seen"),
        F.sum("e").alias("covered"),
        F.count(F.lit(1)).alias("k"),
        F.max("n").alias("n"),
        F.max("dof").alias("dof"),
        F.max("rows").alias("rows"),
        F.max("cols").alias("cols"),
    )
    # An unobserved cell deviates by its whole expected count, so it adds that count; together
    # the unobserved cells add n minus the expected counts already covered. In a 2x2 table the
    # empty cells (one, or two on a diagonal) have equal expected counts and shrink like the rest.
    missing = dbl(F.col("rows") * F.col("cols") - F.col("k"))
    rest = F.greatest(dbl("n") - F.col("covered"), F.lit(0.0))
    each = F.try_divide(rest, missing)
    corrected = missing * F.try_divide(F.pow(each - F.least(F.lit(0.5), each), F.lit(2.0)), each)
    unseen = F.when(missing == 0, 0.0).when(one_dof, corrected).otherwise(rest)
    return (
        summed.withColumn("chi2_statistic", F.when(F.col("dof") > 0, F.col("seen") + unseen).otherwise(0.0))
        .withColumn(
            "cramers_v",
            F.sqrt(ratio("chi2_statistic", F.col("n") * (F.least("rows", "cols") - 1))),
        )
        .select(
            "chi2_statistic",
            F.col("dof").alias("degrees_of_freedom"),
            "cramers_v",
            F.col("n").alias("n_observations"),
        )
    )


def kaplan_meier(frame: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Survival curve per group: the window runs over distinct durations, not over subjects."""
    counted = frame.groupBy(F.col(group).alias("group"), F.col(duration).alias("t")).agg(
        F.count(F.lit(1)).alias("leaving"), F.count_if(F.col(event) == 1).alias("events")
    )
    onwards = W.partitionBy("group").orderBy("t").rowsBetween(W.currentRow, W.unboundedFollowing)
    until = W.partitionBy("group").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        counted.withColumn("n_at_risk", F.sum("leaving").over(onwards))
        .withColumn("survival", F.product(1 - ratio("events", "n_at_risk")).over(until))
        .select("group", "t", "n_at_risk", "events", "survival")
    )
