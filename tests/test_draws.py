"""Draws and tails of distributions inside the JVM."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.functions import draws, stats
from usagelens.functions.columns import dense


def uniform(*key):
    return (int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def binomial_draw(n, ok, u):
    p, total = ok / n, 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= u:
            return k
    return n


def poisson_draw(mean, u):
    k, mass, total = 0, math.exp(-mean), math.exp(-mean)
    while total < u and k < 500:
        k += 1
        mass *= mean / k
        total += mass
    return k


def test_binomial_intervals_are_quantiles_of_all_draws(spark):
    cases = [("a", 40, 13), ("b", 7, 0), ("c", 9, 9), ("d", 1, 1), ("e", 200, 199), ("f", 300, 150)]
    counts = spark.createDataFrame(cases, "g string, n long, ok long")
    got = {r.g: (r.ci_low, r.ci_high) for r in draws.binomial_interval(counts, ["g"], "n", "ok", 400).collect()}
    for g, n, ok in cases:
        rates = [binomial_draw(n, ok, uniform(g, r)) / n if 0 < ok < n else ok / n for r in range(1, 401)]
        assert got[g] == pytest.approx(tuple(np.percentile(rates, [2.5, 97.5])), abs=1e-12)


def test_binomial_steps_of_a_large_group_stay_few(spark):
    counts = spark.createDataFrame([("a", 10**10, 4 * 10**9)], "g string, n long, ok long")
    steps = draws.binomial_steps(counts, ["g"], "n", "ok")
    row = steps.agg(F.count("*").alias("n"), F.max("cdf").alias("top"), F.min("cdf").alias("low")).first()
    assert row["n"] < 1_100_000 and row["top"] == pytest.approx(1) and row["low"] < 1e-20


def test_poisson_draws(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 90)], "g string, c long")
    got = {(r.g, r.replicate): r.w for r in draws.poisson_draws(counts, ["g"], "c", 300).repartition(3).collect()}
    assert got == {(g, r): poisson_draw(c, uniform(g, r)) for g, c in (("a", 1), ("b", 3), ("c", 90)) for r in range(1, 301)}


def chi_tail(x, k):
    """Simpson's rule over the density for the tail, in steps of the square root."""
    if x <= 0 or k <= 0:
        return 1.0
    low, high = math.sqrt(x), math.sqrt(x) + 40
    s = np.linspace(low, high, 200_001)
    f = np.exp((k - 1) * np.log(np.maximum(s, 1e-300)) - s * s / 2 - (k / 2 - 1) * math.log(2) - math.lgamma(k / 2))
    return float((f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (s[1] - s[0]) / 3)


def test_chi_square_tail(spark):
    cases = [(float(x), k) for x in (0, 0.3, 2.7, 12.651, 40, 200, 900) for k in (0, 1, 2, 3, 4, 5, 12, 33, 100)]
    frame = spark.createDataFrame([*cases, (None, 3), (1.0, None)], "x double, k int")
    for r in frame.withColumn("p", stats.chi_square_tail(F.col("x"), F.col("k"))).collect():
        if r.x is None or r.k is None:
            assert r.p is None
        else:
            assert r.p == pytest.approx(chi_tail(r.x, r.k), rel=1e-8, abs=1e-12)


def test_student_tail(spark):
    times = [0.0, 1e-6, 0.1, -1.0, 2.3, 12.0, 300.0]
    frame = spark.createDataFrame([(t, k) for t in times for k in (1, 2, 10**9)] + [(None, 2), (1.0, 0)], "t double, k long")
    for r in frame.withColumn("p", stats.student_t_two_sided(F.col("t"), F.col("k"))).collect():
        if r.t is None or r.k == 0:
            assert r.p is None
            continue
        t = abs(r.t)
        want = {1: 1 - 2 / math.pi * math.atan(t), 2: 1 - t / math.sqrt(2 + t * t)}.get(r.k, math.erfc(t / math.sqrt(2)))
        assert r.p == pytest.approx(want, abs=1e-12 if r.k < 3 else 1e-8)


def test_no_python_workers_in_resampling(spark, tables):
    from usagelens.plans.catalog import QUERIES

    for name in ("l04_chi_square", "l06_bootstrap_rate_ci", "l07_routing_policy", "l09_rating_status_spearman", "p06_bootstrap_revenue_ci"):
        plan = QUERIES[name](tables)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan, name


def test_dense_adds_missing_pairs(spark):
    cells = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "r string, c string, n long")
    assert sorted(map(tuple, dense(cells, "r", "c").collect()), key=str) == [("a", "x", 1), ("a", "y", None), ("b", "x", None), ("b", "y", 2)]
