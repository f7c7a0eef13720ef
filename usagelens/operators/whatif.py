"""Workbook tables and the pricing what-if model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import (
    count_where,
    dbl,
    is_paid,
    literal_frame,
    margin,
    month_of,
    ratio,
    scalar,
    succeeded,
    sum_where,
)
from usagelens.operators.pricing import arc_elasticity
from usagelens.operators.reports import assigned_conversions
from usagelens.operators.usage import activation_scores, billing_with_cost, success_rate
from usagelens.schemas import ALL_PLANS, BALANCED_MODEL, FRONTIER_MODEL, PAID_PLANS, SIMPLE_TASKS

TOTAL_ROW = "Total / blended"

# Prices, routed share and churn change of the comparison scenarios.
SCENARIOS = {
    "Status Quo": {"Pro": None, "Team": None, "Enterprise": None, "routed": 0.0, "churn": 0.0},
    "Scenario A": {"Pro": 34.0, "Team": 159.0, "Enterprise": 1200.0, "routed": 0.30, "churn": 0.0},
    "Scenario B": {"Pro": 29.0, "Team": 149.0, "Enterprise": 1250.0, "routed": 0.60, "churn": 0.03},
    "Scenario C": {"Pro": 39.0, "Team": 179.0, "Enterprise": 1350.0, "routed": 0.60, "churn": 0.03},
}


def workbook_monthly_kpis(months: DataFrame, runs: DataFrame) -> DataFrame:
    """Monthly totals over all plans, with the paid share separated."""
    return (
        billing_with_cost(months, runs)
        .groupBy("month")
        .agg(
            sum_where(is_paid(), "monthly_fee_usd").alias("mrr"),
            sum_where(is_paid(), "revenue_usd").alias("paid_revenue"),
            sum_where(is_paid(), "llm_cost_usd").alias("paid_llm_cost"),
            F.sum("llm_cost_usd").alias("total_llm_cost"),
            F.countDistinct("customer_id").alias("active_customers"),
            count_where(is_paid()).alias("paid_customers"),
        )
        .withColumn("gross_margin", margin("paid_revenue", "paid_llm_cost"))
    )


def workbook_plan_economics(months: DataFrame, runs: DataFrame) -> DataFrame:
    """Every plan in its fixed order (``plan_order``); margin is NULL without revenue."""
    order = F.array_position(F.array(*[F.lit(p) for p in ALL_PLANS]), F.col("plan"))
    return (
        billing_with_cost(months, runs)
        .groupBy("plan")
        .agg(
            F.countDistinct("customer_id").alias("customers"),
            F.count(F.lit(1)).alias("customer_months"),
            F.sum("revenue_usd").alias("revenue"),
            F.sum("llm_cost_usd").alias("llm_cost"),
        )
        .withColumn("gross_margin", margin("revenue", "llm_cost"))
        .withColumn("plan_order", order)
    )


def workbook_model_task(runs: DataFrame) -> DataFrame:
    """Volume, success, cost and latency by model and task."""
    return runs.groupBy("model", "task_type").agg(
        F.count(F.lit(1)).alias("n_runs"),
        success_rate().alias("success_rate"),
        ratio(F.sum("llm_cost_usd"), F.count("llm_cost_usd")).alias("avg_cost_per_run"),
        ratio(F.sum("llm_cost_usd"), count_where(succeeded())).alias("cost_per_success"),
        F.avg("latency_sec").alias("avg_latency_sec"),
    )


def customer_summary(customers: DataFrame, months: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per customer; missing figures are 0, missing activation is false."""
    revenue = months.groupBy("customer_id").agg(F.sum("revenue_usd").alias("total_revenue"))
    usage = runs.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        success_rate().alias("success_rate"),
        F.sum("llm_cost_usd").alias("total_llm_cost"),
    )
    first = activation_scores(runs).withColumnRenamed("activation_score", "first5_success_rate")
    attributes = [
        "customer_id", "company_name", "industry", "company_size", "region",
        "acquisition_channel", "current_plan", "status", "signup_date", "churn_date",
    ]
    figures = ["total_revenue", "total_runs", "success_rate", "total_llm_cost", "first5_success_rate"]
    return (
        customers.select(*attributes)
        .join(revenue, "customer_id", "left")
        .join(usage, "customer_id", "left")
        .join(first, "customer_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in figures})
        .withColumn("activated", F.col("first5_success_rate") >= 0.6)
        .withColumn("gross_margin", margin("total_revenue", "total_llm_cost"))
    )


def customer_month_flat(months: DataFrame, runs: DataFrame, customers: DataFrame) -> DataFrame:
    """Billing rows with run cost, margin and customer attributes."""
    attributes = customers.select("customer_id", "industry", "company_size", "region", "acquisition_channel")
    return (
        billing_with_cost(months, runs)
        .withColumnRenamed("llm_cost_usd", "llm_cost")
        .withColumn("gross_margin", margin("revenue_usd", "llm_cost"))
        .join(attributes, "customer_id", "left")
    )


# -- simulator -------------------------------------------------------------------------


def _plan_task_usage(months: DataFrame, runs: DataFrame, simple_tasks: Sequence[str]) -> DataFrame:
    """Runs, cost and frontier cost on simple tasks per (paid plan, task); runs outside billing drop out."""
    frontier_simple = (F.col("model") == FRONTIER_MODEL) & F.col("task_type").isin(*simple_tasks)
    usage = runs.groupBy("customer_id", month_of("started_at").alias("month"), "task_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("llm_cost_usd").alias("cost"),
        F.sum(F.when(frontier_simple, F.col("llm_cost_usd"))).alias("frontier_cost"),
    )
    billed = months.where(F.col("plan").isin(*PAID_PLANS)).select("customer_id", "month", "plan")
    return (
        usage.join(billed, ["customer_id", "month"])
        .groupBy("plan", "task_type")
        .agg(*[F.sum(c).alias(c) for c in ("n", "cost", "frontier_cost")])
    )


def _paid_plan_billing(months: DataFrame) -> DataFrame:
    return (
        months.where(F.col("plan").isin(*PAID_PLANS))
        .groupBy("plan")
        .agg(F.count(F.lit(1)).alias("n_months"), F.sum("revenue_usd").alias("revenue"))
    )


def _task_figures(runs: DataFrame, simple_tasks: Sequence[str]) -> DataFrame:
    """One row from one scan: mean credits by task (a map of the few tasks) and the reduction factor.

    The reduction is the relative saving of the balanced over the frontier model on simple tasks.
    """
    simple = F.col("task_type").isin(*simple_tasks)
    cost = F.col("llm_cost_usd")
    models = {"b": BALANCED_MODEL, "f": FRONTIER_MODEL}
    per_task = runs.groupBy("task_type").agg(
        ratio(F.sum("credits_charged"), F.count("credits_charged")).alias("avg_credits"),
        *[F.sum(F.when(simple & (F.col("model") == m), cost)).alias(f"{k}_cost") for k, m in models.items()],
        *[F.count_if(simple & (F.col("model") == m)).alias(f"{k}_runs") for k, m in models.items()],
    )
    balanced, frontier = (ratio(F.sum(f"{k}_cost"), F.sum(f"{k}_runs")) for k in models)
    entries = F.collect_list(F.struct("task_type", "avg_credits"))
    return per_task.agg(
        F.map_from_entries(entries).alias("avg_credits"), (1 - F.try_divide(balanced, frontier)).alias("reduction")
    ).select(F.struct("avg_credits", "reduction").alias("figures"))


def simulator_task_mix(
    plans: DataFrame, months: DataFrame, runs: DataFrame, simple_tasks: Sequence[str] = SIMPLE_TASKS
) -> DataFrame:
    """X06, long part: mean runs per customer-month and mean credits by (paid plan, task)."""
    # every paid plan appears with every task of the data
    grid = (
        plans.where(F.col("plan").isin(*PAID_PLANS))
        .withColumn("figures", scalar(_task_figures(runs, simple_tasks), "figures"))
        .select("plan", F.explode("figures.avg_credits").alias("task_type", "avg_credits"))
    )
    usage = _plan_task_usage(months, runs, simple_tasks).select("plan", "task_type", "n")
    return (
        grid.join(usage, ["plan", "task_type"], "left")
        .join(_paid_plan_billing(months).select("plan", "n_months"), "plan", "left")
        .select(
            "plan",
            "task_type",
            ratio(F.coalesce("n", F.lit(0)), F.coalesce("n_months", F.lit(1))).alias("avg_runs"),
            "avg_credits",
        )
    )


def simulator_baseline(
    plans: DataFrame,
    customers: DataFrame,
    months: DataFrame,
    runs: DataFrame,
    assignments: DataFrame,
    experiment: str,
    simple_tasks: Sequence[str] = SIMPLE_TASKS,
) -> DataFrame:
    """Every baseline figure the pricing model needs, one row per paid plan.

    Runs are read twice (usage by plan, figures by task); all joins are between tables of a
    few plans.
    """
    active = (
        customers.where(F.col("status") == "active")
        .groupBy(F.col("current_plan").alias("plan"))
        .agg(F.count(F.lit(1)).alias("active_customers"))
    )
    usage = _plan_task_usage(months, runs, simple_tasks).groupBy("plan").agg(
        F.sum("cost").alias("cost"),
        F.sum("frontier_cost").alias("frontier_cost"),
        F.collect_list(F.struct("task_type", "n")).alias("mix"),
    )
    elasticity = arc_elasticity(assigned_conversions(assignments, customers, experiment, min_days=0))
    months_of_plan = F.coalesce("n_months", F.lit(1))
    credits_used = F.aggregate(
        F.coalesce("mix", F.array()),
        F.lit(0.0),
        lambda total, t: total + ratio(t["n"], months_of_plan) * F.element_at("figures.avg_credits", t["task_type"]),
    )
    return (
        plans.where(F.col("plan").isin(*PAID_PLANS))
        .join(active, "plan", "left")
        .join(_paid_plan_billing(months), "plan", "left")
        .join(usage, "plan", "left")
        .withColumn("figures", scalar(_task_figures(runs, simple_tasks), "figures"))
        .select(
            "plan",
            dbl("monthly_fee_usd").alias("price"),
            "included_credits",
            dbl("overage_usd_per_credit").alias("overage_rate"),
            F.coalesce("active_customers", F.lit(0)).alias("active_customers"),
            ratio(F.coalesce("cost", F.lit(0)), "n_months").alias("avg_llm_cost"),
            ratio(F.coalesce("frontier_cost", F.lit(0)), "n_months").alias("avg_frontier_simple_cost"),
            credits_used.alias("credits_used"),
            F.col("figures.reduction").alias("reduction_factor"),
            scalar(elasticity, "arc_price_elasticity_of_conversion").alias("elasticity"),
            margin("revenue", F.coalesce("cost", F.lit(0))).alias("actual_margin"),
        )
    )


def _customers_after(price: Column, churn: Column) -> Column:
    """Active customers scaled by the churn change and the elasticity response to the price change."""
    change = F.try_divide(price - F.col("price"), F.col("price"))
    return F.col("active_customers") * (1 + churn) * (1 + F.col("elasticity") * change)


def _cost_per_customer(routed: Column) -> Column:
    return F.col("avg_llm_cost") - F.col("avg_frontier_simple_cost") * routed * F.col("reduction_factor")


def _margin_or_zero(revenue: str, cost: str) -> Column:
    return F.coalesce(F.try_divide(F.col(revenue) - F.col(cost), F.col(revenue)), F.lit(0.0))


def pricing_what_if(
    baseline: DataFrame,
    price_overrides: Mapping[str, float] | None = None,
    pct_routed: float = 0.0,
    churn_change: float = 0.0,
) -> DataFrame:
    """Projected customers, revenue, cost and margin per paid plan with a total row."""
    price = F.col("price")
    for plan, value in (price_overrides or {}).items():
        price = F.when(F.col("plan") == plan, F.lit(float(value))).otherwise(price)
    overage = F.greatest(F.lit(0.0), F.col("credits_used") - F.col("included_credits")) * F.col("overage_rate")
    zero, routed, churn = F.lit(0.0), F.lit(float(pct_routed)), F.lit(float(churn_change))
    projected = baseline.select(
        "plan",
        "credits_used",
        _customers_after(price, churn).alias("customers"),
        ((price + overage) * _customers_after(price, churn)).alias("revenue"),
        (_cost_per_customer(routed) * _customers_after(price, churn)).alias("cost"),
        ((F.col("price") + overage) * _customers_after(F.col("price"), zero)).alias("base_revenue"),
        (_cost_per_customer(zero) * _customers_after(F.col("price"), zero)).alias("base_cost"),
    )
    return (
        projected.rollup("plan")
        .agg(
            F.when(F.grouping("plan") == 0, F.max("credits_used")).alias("credits_used"),
            *[F.sum(c).alias(c) for c in ("customers", "revenue", "cost", "base_revenue", "base_cost")],
        )
        .withColumn("margin", _margin_or_zero("revenue", "cost"))
        .withColumn("baseline_margin", _margin_or_zero("base_revenue", "base_cost"))
        .select(
            F.coalesce("plan", F.lit(TOTAL_ROW)).alias("plan"),
            "customers",
            "credits_used",
            "revenue",
            "cost",
            "margin",
            "baseline_margin",
            ((F.col("margin") - F.col("baseline_margin")) * 100).alias("delta_pp"),
        )
    )


def scenario_grid(baseline: DataFrame, scenarios: Mapping[str, Mapping] = SCENARIOS) -> DataFrame:
    """Revenue (without overage), cost and margin of each scenario against the first one."""
    rows = [
        (
            f"'{name}'",
            str(position),
            f"'{plan}'",
            "CAST(NULL AS DOUBLE)" if inputs[plan] is None else f"{inputs[plan]}D",
            f"{inputs['routed']}D",
            f"{inputs['churn']}D",
        )
        for position, (name, inputs) in enumerate(scenarios.items())
        for plan in PAID_PLANS
    ]
    grid = literal_frame(
        baseline.sparkSession, ["scenario", "position", "plan", "new_price", "routed", "churn"], rows
    )
    price = F.coalesce("new_price", "price")
    customers = _customers_after(price, F.col("churn"))
    totals = (
        baseline.join(grid, "plan")
        .groupBy("scenario", "position")
        .agg(
            F.sum(price * customers).alias("total_revenue"),
            F.sum(_cost_per_customer(F.col("routed")) * customers).alias("total_llm_cost"),
        )
        .withColumn("margin", _margin_or_zero("total_revenue", "total_llm_cost"))
    )
    first = F.first("margin").over(W.orderBy("position"))  # one row per scenario
    return totals.withColumn("delta_vs_status_quo_pp", (F.col("margin") - first) * 100)
