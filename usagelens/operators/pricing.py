"""Margins, the price experiment and pricing scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.columns import dbl, margin, paid_only, pct, ratio, scalar
from usagelens.functions.draws import poisson_draws
from usagelens.functions.ranking import global_rank, quantile_bucket
from usagelens.functions.stats import Z_95, Z_POWER_80, normal_cdf, two_sided_p
from usagelens.operators.reports import assigned_conversions, customer_margin, first_quarter_revenue
from usagelens.operators.usage import billing_with_cost, blended_rate
from usagelens.schemas import BALANCED_MODEL, MIGRATION_TASK, SIMPLE_TASKS_PRICING

PRICES = (29.0, 39.0)  # fixed values: control and treatment price
REPLICATES = 5000
ARMS = ("control", "treatment")


def margin_by_plan(months: DataFrame, runs: DataFrame) -> DataFrame:
    """Revenue, cost and margin per paid plan."""
    totals = billing_with_cost(paid_only(months), runs).groupBy("plan").agg(
        F.sum("revenue_usd").alias("total_revenue_usd"), F.sum("llm_cost_usd").alias("total_llm_cost_usd")
    )
    return totals.withColumn("gross_margin_pct", margin("total_revenue_usd", "total_llm_cost_usd") * 100)


def margin_by_task(runs: DataFrame, months: DataFrame) -> DataFrame:
    """Margin per task with revenue implied by the blended rate per credit."""
    rate = scalar(blended_rate(months), "rate")
    totals = runs.groupBy("task_type").agg(
        F.sum("llm_cost_usd").alias("total_llm_cost_usd"), F.sum("credits_charged").alias("total_credits")
    )
    return totals.withColumn("implied_revenue_usd", F.col("total_credits") * rate).withColumn(
        "margin_pct", margin("implied_revenue_usd", "total_llm_cost_usd") * 100
    )


def margin_by_decile(months: DataFrame, runs: DataFrame) -> DataFrame:
    """Equal-frequency margin deciles over ranks (interpolated edges)."""
    ranked = global_rank(customer_margin(months, runs), ["margin", "customer_id"])
    return (
        ranked.withColumn("decile", quantile_bucket(10))
        .groupBy("decile")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            pct(F.sum("margin"), F.count(F.lit(1))).alias("avg_margin_pct"),
            F.sum("revenue_usd").alias("total_revenue_usd"),
        )
    )


# -- price experiment ------------------------------------------------------------------


def experiment_frame(
    assignments: DataFrame, customers: DataFrame, months: DataFrame, experiment: str
) -> DataFrame:
    """One row per assigned customer with conversion and first-three-month revenue."""
    frame = first_quarter_revenue(assigned_conversions(assignments, customers, experiment), months)
    return frame.select(
        "customer_id", "variant", "assigned_at", "first_paid_date", "converted", "revenue_first_3mo_usd"
    )


def arm_counts(frame: DataFrame) -> DataFrame:
    """One row: n and conversions per arm."""
    control, treatment = F.col("variant") == "control", F.col("variant") == "treatment"
    converted = F.col("converted") == 1
    return frame.agg(
        F.count_if(control).alias("n1"),
        F.count_if(treatment).alias("n2"),
        F.count_if(control & converted).alias("x1"),
        F.count_if(treatment & converted).alias("x2"),
    )


def _arms(frame: DataFrame) -> DataFrame:
    return (
        arm_counts(frame)
        .withColumn("p1", ratio("x1", "n1"))
        .withColumn("p2", ratio("x2", "n2"))
        .withColumn("w1", ratio(F.lit(1), "n1"))
        .withColumn("w2", ratio(F.lit(1), "n2"))
    )


def two_proportion_z(frame: DataFrame) -> DataFrame:
    """Pooled z test of the conversion rates with an unpooled 95 % interval."""
    p1, p2 = F.col("p1"), F.col("p2")
    pooled = ratio(F.col("x1") + F.col("x2"), F.col("n1") + F.col("n2"))
    se = F.sqrt(pooled * (1 - pooled) * (F.col("w1") + F.col("w2")))
    half = 1.96 * F.sqrt(p1 * (1 - p1) * F.col("w1") + p2 * (1 - p2) * F.col("w2"))
    return (
        _arms(frame)
        .withColumn("z_statistic", F.try_divide(p1 - p2, se))
        .select(
            F.col("n1").alias("n_control"),
            F.col("n2").alias("n_treatment"),
            p1.alias("conversion_control"),
            p2.alias("conversion_treatment"),
            (p1 - p2).alias("diff_control_minus_treatment"),
            (p1 - p2 - half).alias("diff_ci_low"),
            (p1 - p2 + half).alias("diff_ci_high"),
            "z_statistic",
            two_sided_p(F.col("z_statistic")).alias("p_value"),
        )
    )


def bootstrap_revenue_ci(frame: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Bootstrap intervals of revenue per assigned customer, per arm and for the difference.

    Poisson bootstrap over distinct (arm, revenue) counts in whole cents: c customers with the same revenue get a
    total weight Poisson(c), one draw a replicate whatever their count. Draws depend on the value alone and sums are
    integers, so the result is independent of partitioning.
    """
    values = (
        frame.where(F.col("variant").isin(*ARMS))
        .groupBy("variant", F.round(F.col("revenue_first_3mo_usd") * 100).cast("long").alias("cents"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    weight, total = [F.sum(F.when(F.col("variant") == arm, F.col("w"))) for arm in ARMS], [
        F.sum(F.when(F.col("variant") == arm, F.col("w") * F.col("cents"))) for arm in ARMS
    ]
    resampled = (
        poisson_draws(values, ["variant", "cents"], "c", replicates)
        .groupBy("replicate")
        .agg(*[ratio(t, w * 100).alias(arm) for arm, w, t in zip(ARMS, weight, total)])
        .withColumn("difference", F.col("treatment") - F.col("control"))
    )
    bounds = resampled.agg(
        *[
            F.percentile(column, F.array(F.lit(0.025), F.lit(0.975))).alias(column)
            for column in ("control", "treatment", "difference")
        ]
    )
    revenue = F.col("revenue_first_3mo_usd")
    means = frame.agg(
        *[
            ratio(F.sum(F.when(F.col("variant") == arm, revenue)), F.count_if(F.col("variant") == arm)).alias(arm)
            for arm in ARMS
        ]
    ).withColumn("difference", F.col("treatment") - F.col("control"))
    metrics = {
        "control_revenue_per_assigned": "control",
        "treatment_revenue_per_assigned": "treatment",
        "diff_treatment_minus_control": "difference",
    }
    limits = {c: scalar(bounds, c) for c in metrics.values()}
    return means.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("metric"),
                        F.col(c).alias("mean"),
                        limits[c][0].alias("ci_low"),
                        limits[c][1].alias("ci_high"),
                    )
                    for name, c in metrics.items()
                ]
            )
        ).alias("r")
    ).select("r.*")


def effect_size(p1: Column, p2: Column) -> Column:
    """Cohen's h."""
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def effect_size_to_p2(h: Column, p1: Column, tolerance: float = 1e-6) -> Column:
    """The proportion that lies h above p1 on the arcsine scale."""
    bounded = F.greatest(F.least(p1, F.lit(1 - tolerance)), F.lit(tolerance))
    return F.pow(F.sin(F.asin(F.sqrt(bounded)) + h / 2), F.lit(2.0))


def recovered_rate(frame: DataFrame) -> DataFrame:
    """P08 on an experiment: the treatment rate recovered from the control rate and the effect size."""
    h = effect_size(F.col("p2"), F.col("p1"))
    return _arms(frame).select(
        F.col("n1").alias("n_control"),
        F.col("n2").alias("n_treatment"),
        effect_size_to_p2(h, F.col("p1")).alias("p2_recovered"),
    )


def power_and_mde(frame: DataFrame) -> DataFrame:
    """Achieved power, minimum detectable effect at 80 % power and required n per arm."""
    h, need = F.col("h"), Z_95 + Z_POWER_80
    root = F.sqrt(F.try_divide(F.lit(1.0), F.col("w1") + F.col("w2")))
    reach = F.abs(h) * root
    return (
        _arms(frame)
        .withColumn("h", effect_size(F.col("p1"), F.col("p2")))
        .select(
            F.col("n1").alias("n_control"),
            F.col("n2").alias("n_treatment"),
            F.col("p1").alias("conversion_control"),
            F.col("p2").alias("conversion_treatment"),
            h.alias("observed_effect_size_h"),
            (normal_cdf(reach - Z_95) + normal_cdf(-reach - Z_95)).alias("achieved_power"),
            (F.abs(effect_size_to_p2(F.try_divide(F.lit(need), root), F.col("p1")) - F.col("p1")) * 100).alias(
                "mde_at_80pct_power_pp"
            ),
            (2 * F.try_divide(F.lit(need * need), h * h)).alias(
                "required_n_per_arm_for_observed_effect_at_80pct_power"
            ),
        )
    )


def arc_elasticity(frame: DataFrame, prices: tuple[float, float] = PRICES) -> DataFrame:
    """Midpoint elasticity of conversion between the two prices."""
    low, high = prices
    q1, q2 = F.col("p1"), F.col("p2")
    change_q = F.try_divide(q2 - q1, (q1 + q2) / 2)
    change_p = (high - low) / ((low + high) / 2)
    return _arms(frame).select(
        F.lit(low).alias("price_control"),
        F.lit(high).alias("price_treatment"),
        q1.alias("conversion_control"),
        q2.alias("conversion_treatment"),
        (change_q / change_p).alias("arc_price_elasticity_of_conversion"),
    )


# -- scenarios -------------------------------------------------------------------------


def pricing_scenarios(
    months: DataFrame,
    runs: DataFrame,
    assignments: DataFrame | None = None,
    simple_tasks: list[str] = SIMPLE_TASKS_PRICING,
    migration_credits: tuple[int, int] = (6, 10),
    pro_increase: int = 10,
    exclude_already_repriced: bool = False,
) -> DataFrame:
    """P10: observed billing and run cost under four pricing scenarios, each with what it assumes in words.

    With ``exclude_already_repriced`` the Pro increase skips customers of the treatment arm.
    """
    paid, pro = paid_only(months), F.col("plan") == "Pro"
    if exclude_already_repriced:
        if assignments is None:
            raise ValueError("exclude_already_repriced needs the experiment assignments")
        repriced = assignments.where(F.col("variant") == "treatment").select("customer_id").distinct()
        paid = paid.join(repriced.withColumn("_repriced", F.lit(True)), "customer_id", "left")
        pro = pro & F.col("_repriced").isNull()
    billed = paid.agg(
        F.sum("revenue_usd").alias("revenue"),
        F.sum("credits_used").alias("credits"),
        F.count_if(pro).alias("pro_months"),
    )
    per_task = runs.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("llm_cost_usd").alias("cost"),
        ratio(
            F.sum(F.when(F.col("model") == BALANCED_MODEL, F.col("llm_cost_usd"))),
            F.count_if(F.col("model") == BALANCED_MODEL),
        ).alias("balanced"),
    )
    simple = F.col("task_type").isin(simple_tasks)
    # a simple task without balanced-model runs has no price, which makes the rerouted total unknown
    present = F.count_if(simple & F.col("balanced").isNotNull()) == len(simple_tasks)
    usage = per_task.agg(
        F.sum("cost").alias("cost"),
        F.coalesce(F.sum(F.when(~simple, F.col("cost"))), F.lit(0)).alias("other_cost"),
        F.when(present, F.sum(F.when(simple, F.col("n") * F.col("balanced")))).alias("rerouted"),
        F.coalesce(F.sum(F.when(F.col("task_type") == MIGRATION_TASK, F.col("n"))), F.lit(0)).alias("migrations"),
    )
    revenue, cost = dbl("revenue"), dbl("cost")
    old, new = migration_credits
    extra_credits = F.col("migrations") * (new - old) * ratio("revenue", "credits")
    whom = "Pro months of customers not repriced before" if exclude_already_repriced else "all Pro months"
    scenarios = {
        "status_quo": (revenue, cost, "Billing and run cost as observed."),
        "complexity_weighted_migration_credits": (
            revenue + extra_credits,
            cost,
            f"A migration run is charged {new} credits instead of {old}, sold at the mean revenue per credit; run cost stays.",
        ),
        "route_simple_tasks_to_balanced_medium": (
            revenue,
            dbl("other_cost") + F.col("rerouted"),
            f"Runs of {', '.join(sorted(simple_tasks))} cost what {BALANCED_MODEL} costs per run of the task; revenue stays.",
        ),
        "pro_39": (
            revenue + F.col("pro_months") * pro_increase,
            cost,
            f"The fee rises by {pro_increase} USD in {whom} and nobody leaves because of it: an upper bound.",
        ),
    }
    base = usage.withColumn("b", scalar(billed.select(F.struct("*").alias("b")), "b")).select("*", "b.*")
    rows = base.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("scenario"),
                        F.lit(text).alias("assumption"),
                        r.alias("total_revenue_usd"),
                        c.alias("total_llm_cost_usd"),
                    )
                    for name, (r, c, text) in scenarios.items()
                ]
            )
        ).alias("s")
    ).select("s.*")
    return rows.withColumn("gross_profit_usd", F.col("total_revenue_usd") - F.col("total_llm_cost_usd")).withColumn(
        "gross_margin_pct", pct("gross_profit_usd", "total_revenue_usd")
    )
