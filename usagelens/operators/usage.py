"""Frames several reports start from. Runs are always pre-aggregated before a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import dbl, month_of, paid_only, ratio, succeeded
from usagelens.schemas import MIGRATION_TASK

WINDOW_SIZE = 5


def total_cost() -> Column:
    return F.sum("llm_cost_usd").alias("llm_cost_usd")


def success_rate() -> Column:
    """Exact: both counts are integers, so the quotient does not depend on row order."""
    return ratio(F.count_if(succeeded()), F.count(F.lit(1)))


def average_cost() -> Column:
    return ratio(F.sum("llm_cost_usd"), F.count("llm_cost_usd"))


def cost_by_customer_month(runs: DataFrame) -> DataFrame:
    return runs.groupBy("customer_id", month_of("started_at").alias("month")).agg(total_cost())


def billing_with_cost(months: DataFrame, runs: DataFrame) -> DataFrame:
    """Billing rows with the run cost of the same customer and month, 0 where there were no runs."""
    return months.join(cost_by_customer_month(runs), ["customer_id", "month"], "left").withColumn(
        "llm_cost_usd", F.coalesce("llm_cost_usd", F.lit(0))
    )


def first_runs(runs: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """The first ``size`` runs per customer; ties on time resolved by run id.

    Spark turns ``row_number <= size`` into a per-task top-k ahead of the shuffle, so a
    customer with a third of all runs sends at most ``size`` rows per task.
    """
    order = W.partitionBy("customer_id").orderBy("started_at", "run_id")
    return (
        runs.select("customer_id", "started_at", "run_id", "status")
        .withColumn("run_rank", F.row_number().over(order))
        .where(F.col("run_rank") <= size)
    )


def activation_counts(runs: DataFrame, size: int = WINDOW_SIZE, require_full_window: bool = False) -> DataFrame:
    counts = first_runs(runs, size).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("runs_considered"),
        F.count_if(succeeded()).alias("successes"),
    )
    return counts.where(F.col("runs_considered") == size) if require_full_window else counts


def activation_scores(runs: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """Success share of each customer's first runs (any number up to ``size``)."""
    return activation_counts(runs, size).select(
        "customer_id", ratio("successes", "runs_considered").alias("activation_score")
    )


def six_month_retention(customers: DataFrame, months: DataFrame) -> DataFrame:
    """retained_6mo per ever-paid customer: 1/0, or NULL while the target month lies ahead."""
    paid = paid_only(months).select("customer_id", F.col("month").alias("target_month"), F.lit(1).alias("_paid"))
    latest = months.agg(F.max("month").alias("m")).select("m").scalar()
    entered = customers.where(F.col("first_paid_date").isNotNull()).select(
        "customer_id", F.add_months(F.trunc("first_paid_date", "month"), 6).alias("target_month")
    )
    return entered.join(paid, ["customer_id", "target_month"], "left").select(
        "customer_id",
        F.when(F.col("target_month") <= latest, F.coalesce("_paid", F.lit(0))).alias("retained_6mo"),
    )


def lifetime_cost(runs: DataFrame) -> DataFrame:
    """All-run cost and migration share per customer."""
    return runs.groupBy("customer_id").agg(
        total_cost(),
        ratio(F.count_if(F.col("task_type") == MIGRATION_TASK), F.count(F.lit(1))).alias("migration_share"),
    )


def paid_revenue(months: DataFrame) -> DataFrame:
    return paid_only(months).groupBy("customer_id").agg(F.sum("revenue_usd").alias("revenue_usd"))


def blended_rate(months: DataFrame) -> DataFrame:
    """One row: paid revenue per credit used."""
    return paid_only(months).agg(ratio(F.sum("revenue_usd"), F.sum("credits_used")).alias("rate"))


def share_of_total(value: str) -> Column:
    """Share within an already aggregated frame (one row per group)."""
    return F.try_divide(dbl(value) * F.lit(100.0), dbl(F.sum(value).over(W.partitionBy())))
