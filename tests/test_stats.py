import math
from statistics import NormalDist

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usagelens.functions import stats
from usagelens.operators import attempts, models, pricing


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_normal_cdf_matches_the_standard_library(spark):
    xs = [-9.0, -5.5, -1.96, -0.3, 0.0, 0.7, 1.44, 3.2, 6.0, 12.0]
    frame = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = {r["x"]: r["p"] for r in frame.select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()}
    assert got.pop(None) is None
    for x, p in got.items():
        assert p == pytest.approx(NormalDist().cdf(x), abs=2e-15)


def test_two_proportion_z_hand_values(make):
    row = one(pricing.two_proportion_z(make.arms(100, 50, 100, 30)))
    assert row["z_statistic"] == pytest.approx(2.8868, abs=1e-4)
    assert row["p_value"] == pytest.approx(0.00389, abs=1e-5)


def test_experiment_statistics_match_published_counts(make):
    frame = make.arms(196, 51, 182, 36)
    z = one(pricing.two_proportion_z(frame))
    assert z["z_statistic"] == pytest.approx(1.44013, abs=1e-5)
    assert z["p_value"] == pytest.approx(0.14983, abs=1e-5)
    power = one(pricing.power_and_mde(frame))
    assert power["observed_effect_size_h"] == pytest.approx(0.148818, abs=1e-6)
    assert power["achieved_power"] == pytest.approx(0.303856, abs=1e-6)
    assert power["mde_at_80pct_power_pp"] == pytest.approx(13.4688, abs=1e-3)
    assert power["required_n_per_arm_for_observed_effect_at_80pct_power"] == pytest.approx(708.81, abs=0.05)
    assert one(pricing.arc_elasticity(frame))["arc_price_elasticity_of_conversion"] == pytest.approx(-0.926478, abs=1e-6)
    assert one(pricing.recovered_rate(frame))["p2_recovered"] == pytest.approx(36 / 182, abs=1e-12)


def test_z_is_null_without_variance(make):
    assert one(pricing.two_proportion_z(make.arms(10, 0, 10, 0)))["z_statistic"] is None


def test_bootstrap_covers_the_mean_and_is_partition_invariant(make):
    frame = make.arms(196, 51, 182, 36)
    few = {r["metric"]: r for r in pricing.bootstrap_revenue_ci(frame.coalesce(1), 500).collect()}
    many = {r["metric"]: r for r in pricing.bootstrap_revenue_ci(frame.repartition(7), 500).collect()}
    assert few == many
    for r in few.values():
        assert r["ci_low"] < r["mean"] < r["ci_high"]
    # Poisson resampling has about the standard error of the sample mean
    arm = few["control_revenue_per_assigned"]
    assert 2.5 < arm["ci_high"] - arm["ci_low"] < 6.5


def contingency(spark, table):
    rows = [(m, s, n) for m, line in table.items() for s, n in line.items() if n]
    counts = spark.createDataFrame(rows, "model string, status string, n int")
    return counts.select("model", "status", F.explode(F.sequence(F.lit(1), "n")))


def test_chi_square_of_the_published_table(spark):
    table = {
        "a": {"failed": 6, "partial": 15, "success": 24},
        "b": {"failed": 9, "partial": 13, "success": 23},
        "c": {"failed": 2, "partial": 6, "success": 37},
    }
    row = one(models.chi_square(contingency(spark, table)))
    assert row["degrees_of_freedom"] == 4 and row["n_observations"] == 135
    assert row["chi2_statistic"] == pytest.approx(12.651, abs=5e-4)
    assert row["p_value"] == pytest.approx(0.01311, abs=5e-6)
    assert row["cramers_v"] == pytest.approx(math.sqrt(row["chi2_statistic"] / (135 * 2)))


def test_chi_square_counts_unobserved_cells(spark):
    table = {
        "a": {"failed": 8, "partial": 0, "success": 37},
        "b": {"failed": 16, "partial": 4, "success": 25},
        "c": {"failed": 20, "partial": 3, "success": 22},
    }
    row = one(models.chi_square(contingency(spark, table)))
    total = {s: sum(t[s] for t in table.values()) for s in ("failed", "partial", "success")}
    expected = sum((t[s] - 45 * total[s] / 135) ** 2 / (45 * total[s] / 135) for t in table.values() for s in total)
    assert row["chi2_statistic"] == pytest.approx(expected)


@pytest.mark.parametrize("cells", [(10, 20, 30, 25), (12, 0, 5, 9), (6, 0, 0, 4)])
def test_chi_square_with_one_degree_of_freedom_is_corrected(spark, cells):
    a, b, c, d = cells
    table = {"x": {"ok": a, "no": b}, "y": {"ok": c, "no": d}}
    n = a + b + c + d
    rows, cols = (a + b, c + d), (a + c, b + d)
    expected = 0.0
    for o, r, k in ((a, 0, 0), (b, 0, 1), (c, 1, 0), (d, 1, 1)):
        e = rows[r] * cols[k] / n
        expected += (abs(o - e) - min(0.5, abs(o - e))) ** 2 / e
    row = one(models.chi_square(contingency(spark, table)))
    assert row["chi2_statistic"] == pytest.approx(expected)
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(expected / 2)), rel=1e-9)


def test_tails_at_known_quantiles(spark):
    frame = spark.range(1).select(
        stats.chi_square_tail(F.lit(3.841458820694124), F.lit(1)).alias("chi1"),
        stats.chi_square_tail(F.lit(12.591587243743977), F.lit(6)).alias("chi6"),
        stats.student_t_two_sided(F.lit(2.2281388519649385), F.lit(10)).alias("t10"),
    )
    row = frame.first()
    assert [row["chi1"], row["chi6"], row["t10"]] == pytest.approx([0.05] * 3, rel=1e-9)


def test_kaplan_meier_hand_values(spark):
    frame = spark.createDataFrame([("g", 1, 1), ("g", 1, 1), ("g", 2, 1), ("g", 3, 0)], "g string, d int, e int")
    rows = sorted(stats.kaplan_meier(frame, "d", "e", "g").collect(), key=lambda r: r["t"])
    assert [(r["t"], r["n_at_risk"], r["events"]) for r in rows] == [(1, 4, 2), (2, 2, 1), (3, 1, 0)]
    assert [r["survival"] for r in rows] == [0.5, 0.25, 0.25]


def test_kaplan_meier_reaches_zero_and_stays(spark):
    frame = spark.createDataFrame([("g", 1, 1), ("g", 2, 1)], "g string, d int, e int")
    assert sorted(r["survival"] for r in stats.kaplan_meier(frame, "d", "e", "g").collect()) == [0.0, 0.5]


def test_wilson_interval(spark):
    frame = spark.createDataFrame([(37, 45), (0, 0), (0, 5), (5, 5)], "k int, n int")
    low, high = stats.wilson_bounds("k", "n")
    got = {(r["k"], r["n"]): (r["lo"], r["hi"]) for r in frame.select("k", "n", low.alias("lo"), high.alias("hi")).collect()}
    assert got[(37, 45)] == pytest.approx((0.687, 0.907), abs=5e-4)
    assert got[(0, 0)] == (0.0, 0.0)
    assert got[(0, 5)][0] == pytest.approx(0, abs=1e-12)
    assert got[(5, 5)][1] == pytest.approx(1, abs=1e-12)


def test_format_p(spark):
    frame = spark.createDataFrame([(0.0,), (0.00099,), (0.001,), (0.0496,)], "p double")
    assert [r[0] for r in frame.select(stats.format_p("p")).collect()] == ["p<0.001", "p<0.001", "p=0.001", "p=0.050"]


def test_spearman_against_ranks(spark, make):
    labels = [("failed", 1), ("failed", 2), ("partial", 2), ("partial", 4), ("success", 3), ("success", 5), ("success", 5)]
    runs = make.runs(*[dict(customer_id="a", status=s, human_rating=r) for s, r in labels], dict(customer_id="a"))
    row = one(models.rating_status_spearman(runs))
    assert row["n_rated_runs"] == 7
    level = {"failed": 0, "partial": 1, "success": 2}

    def ranks(values):
        ordered = sorted(values)
        return [ordered.index(v) + (ordered.count(v) + 1) / 2 for v in values]

    x, y = ranks([level[s] for s, _ in labels]), ranks([r for _, r in labels])
    mx, my = sum(x) / 7, sum(y) / 7
    rho = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(
        sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)
    )
    assert row["spearman_rho"] == pytest.approx(rho)
    assert row["mean_rating_success"] == pytest.approx(13 / 3)
    assert 0 < row["p_value"] < 0.1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 30), st.integers(1, 40)), min_size=1, max_size=20))
def test_pass_at_k_equals_the_binomial_quotient(spark, cases):
    cases = [(n, min(c, n), k) for n, c, k in cases]
    frame = spark.createDataFrame(cases, "n long, c long, k long")
    got = frame.select("n", "c", "k", attempts.pass_estimate(F.col("n"), F.col("c"), F.col("k")).alias("p")).collect()
    for r in got:
        k = min(r["k"], r["n"])
        assert r["p"] == pytest.approx(1 - math.comb(r["n"] - r["c"], k) / math.comb(r["n"], k), abs=1e-12)


def test_grade_rule(spark):
    frame = spark.createDataFrame([(3, 3), (1, 3), (0, 3), (0, 0)], "tests_passed int, tests_total int")
    assert [r[0] for r in frame.select(attempts.grade_status()).collect()] == ["success", "partial", "failed", "failed"]


def test_code_extraction(spark):
    texts = [
        ("fence", "Sure:\n```python\nimport x\n```\nand\n```py\ndef f():\n    return 1\n```\n", "def f():\n    return 1", True),
        ("first", "```\nx = 1\n```\n```\ny = 2\n```", "x = 1", True),
        ("open", "Here you go\n  import os\r\nprint(os)  \n", "import os\nprint(os)", False),
        ("prose", "  nothing to see  ", "nothing to see", False),
    ]
    frame = spark.createDataFrame([(n, t) for n, t, _, _ in texts], "name string, text string")
    got = {r["name"]: (r["code"], r["extracted_cleanly"]) for r in attempts.extract_code(frame).collect()}
    assert got == {n: (code, clean) for n, _, code, clean in texts}


def test_attempt_prices_fall_back_to_the_default_row(spark):
    attempts_frame = spark.createDataFrame(
        [("known", 1_000_000, 500_000), ("new", 2_000_000, 0)], "model string, prompt_tokens long, output_tokens long"
    )
    prices = spark.sql(
        "SELECT * FROM VALUES ('known', 3.0D, 15.0D), ('_default', 0.15D, 0.6D) AS t(model, usd_per_m_input, usd_per_m_output)"
    )
    got = {r["model"]: r["cost_usd"] for r in attempts.price_attempts(attempts_frame, prices).collect()}
    assert got == {"known": 10.5, "new": 0.3}
