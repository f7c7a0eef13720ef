"""The twelve named reports. Percentages and ratios are unrounded doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import (
    count_where,
    dbl,
    flag,
    month_of,
    months_between_starts,
    paid_only,
    pct,
    ratio,
    scalar,
    succeeded,
)
from usagelens.functions.ranking import global_rank, ntile_of
from usagelens.operators.usage import (
    activation_counts,
    average_cost,
    billing_with_cost,
    blended_rate,
    lifetime_cost,
    paid_revenue,
    share_of_total,
    six_month_retention,
)
from usagelens.schemas import MIGRATION_TASK

CONVERSION_DAYS = 30


def monthly_kpis(months: DataFrame, customers: DataFrame) -> DataFrame:
    """MRR, revenue, ARPA, logos and growth against the previous paid month."""
    billed = paid_only(months).groupBy("month").agg(
        F.sum("monthly_fee_usd").alias("mrr_usd"),
        F.sum("revenue_usd").alias("revenue_usd"),
        F.countDistinct("customer_id").alias("active_paid_customers"),
    )
    ever_paid = customers.where(F.col("first_paid_date").isNotNull())
    # both logo counts from one pass over customers
    logos = (
        ever_paid.select(
            F.explode(
                F.array(
                    F.struct(month_of("first_paid_date").alias("month"), F.lit(1).alias("new"), F.lit(0).alias("lost")),
                    F.struct(month_of("churn_date").alias("month"), F.lit(0).alias("new"), F.lit(1).alias("lost")),
                )
            ).alias("e")
        )
        .where(F.col("e.month").isNotNull())
        .groupBy(F.col("e.month").alias("month"))
        .agg(F.sum("e.new").alias("new_logos"), F.sum("e.lost").alias("churned_logos"))
    )
    by_month = W.orderBy("month")

    def growth(column: str):
        before = F.lag(column).over(by_month)
        return pct(F.col(column) - before, before)

    return billed.join(logos, "month", "left").select(
        "month",
        "mrr_usd",
        "revenue_usd",
        "active_paid_customers",
        ratio("mrr_usd", "active_paid_customers").alias("arpa_usd"),
        F.coalesce("new_logos", F.lit(0)).alias("new_logos"),
        F.coalesce("churned_logos", F.lit(0)).alias("churned_logos"),
        growth("mrr_usd").alias("mrr_mom_growth_pct"),
        growth("active_paid_customers").alias("active_customers_mom_growth_pct"),
    )


def nrr_grr(months: DataFrame) -> DataFrame:
    """Net and gross revenue retention into each calendar month."""
    timeline = W.partitionBy("customer_id").orderBy("month")
    target = F.add_months("month", 1)
    latest = scalar(months.agg(F.max("month").alias("m")), "m")
    moves = (
        paid_only(months)
        .select(
            target.alias("target"),
            F.col("revenue_usd").alias("base"),
            F.when(F.lead("month").over(timeline) == target, F.lead("revenue_usd").over(timeline))
            .otherwise(F.lit(0))
            .alias("kept"),
        )
        .where(F.col("target") <= latest)
    )
    # a NULL on either side of the cap makes the capped value NULL
    capped = F.when(F.col("kept").isNotNull() & F.col("base").isNotNull(), F.least("kept", "base"))
    return (
        moves.groupBy(F.col("target").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("cohort_customers"),
            F.sum("base").alias("base_revenue_usd"),
            F.sum("kept").alias("retained_revenue_usd"),
            F.sum(capped).alias("grr_capped_revenue_usd"),
        )
        .withColumn("nrr_pct", pct("retained_revenue_usd", "base_revenue_usd"))
        .withColumn("grr_pct", pct("grr_capped_revenue_usd", "base_revenue_usd"))
    )


def cohort_retention(months: DataFrame, customers: DataFrame) -> DataFrame:
    """Paid-logo retention by signup cohort and months since signup (sparse)."""
    cohorts = customers.select("customer_id", month_of("signup_date").alias("cohort_month"))
    sizes = cohorts.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    retained = (
        paid_only(months)
        .join(cohorts, "customer_id")
        .groupBy("cohort_month", months_between_starts("month", "cohort_month").alias("months_since_signup"))
        .agg(F.count(F.lit(1)).alias("retained_customers"))
    )
    within = W.partitionBy("cohort_month").orderBy("months_since_signup")
    return (
        retained.join(sizes, "cohort_month")
        .withColumn("retention_pct", pct("retained_customers", "cohort_size"))
        .withColumn(
            "retention_pct_change_vs_prior_month",
            F.col("retention_pct") - F.lag("retention_pct").over(within),
        )
    )


def activation(runs: DataFrame, customers: DataFrame, months: DataFrame) -> DataFrame:
    """Conversion and six-month retention by successes in a full first-five window."""
    scored = activation_counts(runs, require_full_window=True)
    retention = six_month_retention(customers, months).where(F.col("retained_6mo").isNotNull())
    self_serve = F.col("is_sales_led") == 0
    converted = self_serve & F.col("first_paid_date").isNotNull()
    buckets = (
        scored.join(customers.select("customer_id", "is_sales_led", "first_paid_date"), "customer_id")
        .join(retention, "customer_id", "left")
        .groupBy(F.col("successes").alias("successes_out_of_5"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            count_where(converted).alias("_converted"),
            count_where(self_serve).alias("self_serve_customers"),
            F.sum("retained_6mo").alias("retained_6mo_count"),
            F.count("retained_6mo").alias("paid_customers_with_6mo_window"),
        )
        .withColumn("_rate", ratio("_converted", "self_serve_customers"))
    )
    return buckets.select(
        "successes_out_of_5",
        "customers",
        (F.col("_rate") * 100).alias("self_serve_conversion_pct"),
        "self_serve_customers",
        pct("retained_6mo_count", "paid_customers_with_6mo_window").alias("retained_6mo_pct_of_paid"),
        "retained_6mo_count",
        "paid_customers_with_6mo_window",
        F.rank().over(W.orderBy(F.desc_nulls_last("_rate"))).alias("conversion_rank"),
    )


def channel_performance(customers: DataFrame, months: DataFrame) -> DataFrame:
    """Acquisition-channel scorecard with conversion and churn ranks."""
    self_serve = F.col("is_sales_led") == 0
    ever_paid = F.col("first_paid_date").isNotNull()
    revenue = F.coalesce("revenue_usd", F.lit(0))
    scored = (
        customers.join(paid_revenue(months), "customer_id", "left")
        .groupBy("acquisition_channel")
        .agg(
            F.count(F.lit(1)).alias("signups"),
            count_where(self_serve).alias("self_serve_signups"),
            count_where(self_serve & ever_paid).alias("self_serve_conversions"),
            count_where(ever_paid).alias("paid_logos"),
            count_where(ever_paid & (F.col("status") == "churned")).alias("paid_logos_churned"),
            F.sum(revenue).alias("total_lifetime_revenue_usd"),
        )
        .withColumn("self_serve_conversion_pct", pct("self_serve_conversions", "self_serve_signups"))
        .withColumn("paid_logo_churn_pct", pct("paid_logos_churned", "paid_logos"))
        .withColumn("avg_lifetime_revenue_per_signup_usd", ratio("total_lifetime_revenue_usd", "signups"))
    )
    return scored.withColumn(
        "conversion_rank", F.rank().over(W.orderBy(F.desc_nulls_last("self_serve_conversion_pct")))
    ).withColumn("retention_rank", F.rank().over(W.orderBy(F.asc_nulls_first("paid_logo_churn_pct"))))


def model_task_matrix(runs: DataFrame) -> DataFrame:
    """Outcome mix, cost and latency per model and task, from one scan.

    Runs are first counted per distinct latency (0.1 s resolution). The nearest-rank percentile
    q, the latency at row trunc(q n) + 1, comes from running counts over those few rows, so no
    group of runs is ever sorted.
    """
    keys = ["model", "task_type"]
    sums = ["n_runs", "n_success", "n_partial", "n_failed", "cost", "cost_n", "tin", "tin_n", "tout", "tout_n"]
    counted = runs.groupBy(*keys, "latency_sec").agg(
        F.count(F.lit(1)).alias("n_runs"),
        count_where(succeeded()).alias("n_success"),
        count_where(F.col("status") == "partial").alias("n_partial"),
        count_where(F.col("status") == "failed").alias("n_failed"),
        F.sum("llm_cost_usd").alias("cost"),
        F.count("llm_cost_usd").alias("cost_n"),
        F.sum("input_tokens").alias("tin"),
        F.count("input_tokens").alias("tin_n"),
        F.sum("output_tokens").alias("tout"),
        F.count("output_tokens").alias("tout_n"),
        F.count("latency_sec").alias("timed"),
    )
    upto = W.partitionBy(*keys).orderBy("latency_sec").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("last", F.sum("timed").over(upto)).withColumn(
        "n_timed", F.sum("timed").over(W.partitionBy(*keys))
    )

    def latency_at(q: float):
        wanted = F.floor(F.col("n_timed") * q) + 1
        return F.min(F.when(F.col("last") >= wanted, F.col("latency_sec")))

    totals = ranked.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        latency_at(0.5).alias("p50_latency_sec"),
        latency_at(0.9).alias("p90_latency_sec"),
    )
    return totals.select(
        *keys,
        "n_runs",
        "n_success",
        "n_partial",
        "n_failed",
        pct("n_success", "n_runs").alias("success_pct"),
        pct("n_partial", "n_runs").alias("partial_pct"),
        pct("n_failed", "n_runs").alias("failed_pct"),
        ratio("cost", "cost_n").alias("avg_llm_cost_usd"),
        F.col("cost").alias("total_llm_cost_usd"),
        ratio("cost", "n_success").alias("cost_per_success_usd"),
        ratio("tin", "tin_n").alias("avg_input_tokens"),
        ratio("tout", "tout_n").alias("avg_output_tokens"),
        "p50_latency_sec",
        "p90_latency_sec",
    )


def migration_pairs(runs: DataFrame) -> DataFrame:
    """Economics of each source -> target migration pair."""
    pairs = (
        runs.where(F.col("task_type") == MIGRATION_TASK)
        .groupBy(F.concat("source_stack", F.lit(" -> "), "target_stack").alias("migration_pair"))
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            count_where(succeeded()).alias("n_success"),
            average_cost().alias("avg_llm_cost_usd"),
            F.sum("llm_cost_usd").alias("total_llm_cost_usd"),
            ratio(F.sum("steps"), F.count("steps")).alias("avg_steps"),
            ratio(F.sum("credits_charged"), F.count("credits_charged")).alias("avg_credits_charged"),
            F.sum("credits_charged").alias("_credits"),
        )
        .withColumn("llm_cost_per_credit_usd", ratio("total_llm_cost_usd", "_credits"))
    )
    return pairs.select(
        "migration_pair",
        "n_runs",
        "n_success",
        pct("n_success", "n_runs").alias("success_pct"),
        "avg_llm_cost_usd",
        "total_llm_cost_usd",
        "avg_steps",
        "avg_credits_charged",
        "llm_cost_per_credit_usd",
        F.rank().over(W.orderBy(F.desc_nulls_last("llm_cost_per_credit_usd"))).alias("cost_per_credit_rank"),
        share_of_total("n_runs").alias("pct_of_migration_volume"),
    )


def unit_economics_plan(months: DataFrame, runs: DataFrame) -> DataFrame:
    """Margin, cost and revenue per credit by paid plan, worst margin ranked first."""
    plans = (
        billing_with_cost(paid_only(months), runs)
        .groupBy("plan")
        .agg(
            F.countDistinct("customer_id").alias("paying_customers"),
            F.count(F.lit(1)).alias("customer_months"),
            F.sum("revenue_usd").alias("total_revenue_usd"),
            F.sum("llm_cost_usd").alias("total_llm_cost_usd"),
            F.sum("credits_used").alias("_credits"),
        )
    )
    profit = F.col("total_revenue_usd") - F.col("total_llm_cost_usd")
    return plans.select(
        "plan",
        "paying_customers",
        "customer_months",
        "total_revenue_usd",
        "total_llm_cost_usd",
        profit.alias("gross_profit_usd"),
        pct(profit, "total_revenue_usd").alias("gross_margin_pct"),
        ratio("total_llm_cost_usd", "_credits").alias("llm_cost_per_credit_usd"),
        ratio("total_revenue_usd", "_credits").alias("revenue_per_credit_usd"),
    ).withColumn(
        "margin_rank_worst_first", F.rank().over(W.orderBy(F.asc_nulls_first("gross_margin_pct")))
    )


def task_cost_per_credit(runs: DataFrame, months: DataFrame) -> DataFrame:
    """LLM cost per credit by task against one blended revenue rate."""
    rate = scalar(blended_rate(months), "rate")
    tasks = runs.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n_runs"),
        count_where(succeeded()).alias("_success"),
        F.sum("llm_cost_usd").alias("total_llm_cost_usd"),
        F.sum("credits_charged").alias("_credits"),
        ratio(F.sum("credits_charged"), F.count("credits_charged")).alias("credits_per_task"),
    )
    return (
        tasks.withColumn("llm_cost_per_credit_usd", ratio("total_llm_cost_usd", "_credits"))
        .withColumn("blended_revenue_per_credit_usd", rate)
        .withColumn("margin_per_credit_usd", F.col("blended_revenue_per_credit_usd") - F.col("llm_cost_per_credit_usd"))
        .select(
            "task_type",
            "n_runs",
            pct("_success", "n_runs").alias("success_pct"),
            "credits_per_task",
            "total_llm_cost_usd",
            "llm_cost_per_credit_usd",
            "blended_revenue_per_credit_usd",
            "margin_per_credit_usd",
            F.rank()
            .over(W.orderBy(F.asc_nulls_first("margin_per_credit_usd")))
            .alias("margin_per_credit_rank_worst_first"),
        )
    )


def customer_margin(months: DataFrame, runs: DataFrame) -> DataFrame:
    """Lifetime margin per customer with positive paid revenue; cost is over all of its runs."""
    return (
        paid_revenue(months)
        .where(F.col("revenue_usd") > 0)
        .join(lifetime_cost(runs), "customer_id", "left")
        .select(
            "customer_id",
            "revenue_usd",
            F.coalesce("llm_cost_usd", F.lit(0)).alias("llm_cost_usd"),
            F.coalesce("migration_share", F.lit(0.0)).alias("migration_share"),
        )
        .withColumn("profit_usd", F.col("revenue_usd") - F.col("llm_cost_usd"))
        .withColumn("margin", ratio("profit_usd", "revenue_usd"))
    )


def customer_margin_deciles(months: DataFrame, runs: DataFrame, customers: DataFrame) -> DataFrame:
    """NTILE(10) by lifetime margin; ties broken by customer id, plan mode by plan name."""
    margins = customer_margin(months, runs).join(
        customers.select("customer_id", "current_plan"), "customer_id", "left"
    )
    per_plan = (
        global_rank(margins, ["margin", "customer_id"])
        .withColumn("margin_decile", ntile_of(10))
        .groupBy("margin_decile", "current_plan")
        .agg(
            F.count(F.lit(1)).alias("c"),
            F.sum("margin").alias("m"),
            F.min("margin").alias("lo"),
            F.max("margin").alias("hi"),
            F.sum("revenue_usd").alias("revenue"),
            F.sum("profit_usd").alias("profit"),
            F.sum("migration_share").alias("share"),
        )
    )
    # smallest struct: most customers first, then plan name; customers without a plan never win
    votes = F.when(F.col("current_plan").isNotNull(), F.struct((-F.col("c")).alias("votes"), "current_plan"))
    return per_plan.groupBy("margin_decile").agg(
        F.sum("c").alias("customers"),
        pct(F.sum("m"), F.sum("c")).alias("avg_margin_pct"),
        (F.min("lo") * 100).alias("min_margin_pct"),
        (F.max("hi") * 100).alias("max_margin_pct"),
        F.sum("revenue").alias("total_revenue_usd"),
        F.sum("profit").alias("total_gross_profit_usd"),
        pct(F.sum("share"), F.sum("c")).alias("avg_migration_share_pct"),
        F.min(votes)["current_plan"].alias("most_common_plan"),
    )


def assigned_conversions(
    assignments: DataFrame, customers: DataFrame, experiment: str, min_days: int | None = None
) -> DataFrame:
    """Assigned customers of one experiment with the conversion flag (paid within 30 days)."""
    days = F.datediff("first_paid_date", "assigned_at")
    within = days <= CONVERSION_DAYS
    if min_days is not None:
        within = within & (days >= min_days)
    return (
        assignments.where(F.col("experiment_name") == experiment)
        .join(customers.select("customer_id", "first_paid_date"), "customer_id")
        .withColumn("converted", flag(within))
    )


def first_quarter_revenue(assigned: DataFrame, months: DataFrame, window_months: int = 3) -> DataFrame:
    """Adds revenue of the first calendar months from the first paid month; 0 unless converted."""
    entry = F.trunc("first_paid_date", "month")
    converted = assigned.where(F.col("converted") == 1).select("customer_id", entry.alias("_from")).distinct()
    in_window = (F.col("month") >= F.col("_from")) & (F.col("month") < F.add_months("_from", window_months))
    revenue = (
        paid_only(months)
        .join(converted, "customer_id")
        .where(in_window)
        .groupBy("customer_id")
        .agg(F.sum("revenue_usd").alias("revenue_first_3mo_usd"))
    )
    return assigned.join(revenue, "customer_id", "left").withColumn(
        "revenue_first_3mo_usd", F.coalesce("revenue_first_3mo_usd", F.lit(0))
    )


def experiment_results(
    assignments: DataFrame, customers: DataFrame, months: DataFrame, experiment: str
) -> DataFrame:
    """Conversion and early revenue per variant."""
    frame = first_quarter_revenue(assigned_conversions(assignments, customers, experiment), months)
    arms = frame.groupBy("variant", "pro_price_shown").agg(
        F.count(F.lit(1)).alias("n_assigned"),
        F.sum("converted").alias("n_converted_30d"),
        F.sum("revenue_first_3mo_usd").alias("total_revenue_first_3mo_usd"),
    )
    return (
        arms.withColumn("conversion_pct", pct("n_converted_30d", "n_assigned"))
        .withColumn("avg_revenue_per_assigned_first_3mo_usd", ratio("total_revenue_first_3mo_usd", "n_assigned"))
        .withColumn("pct_of_all_converters", share_of_total("n_converted_30d"))
    )


def failure_cost(runs: DataFrame) -> DataFrame:
    """Cost of failed runs by model and task, with running share of the failed spend."""
    failed = F.col("status") == "failed"
    groups = runs.groupBy("model", "task_type").agg(
        F.count_if(failed).alias("n_failed_runs"),
        F.sum(F.when(failed, F.col("llm_cost_usd"))).alias("failed_llm_cost_usd"),
        ratio(F.sum(F.when(failed, F.col("steps"))), F.count(F.when(failed, F.col("steps")))).alias(
            "avg_steps_on_failure"
        ),
        F.sum("llm_cost_usd").alias("_all"),
    )
    # one scan: the grand total is a window sum over the groups, taken before dropping groups without failures
    priced = groups.withColumn("_total", F.sum("_all").over(W.partitionBy())).where(F.col("n_failed_runs") > 0)
    running = W.orderBy(F.desc("failed_llm_cost_usd"), "model", "task_type").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return priced.select(
        "model",
        "task_type",
        "n_failed_runs",
        "failed_llm_cost_usd",
        "avg_steps_on_failure",
        pct("failed_llm_cost_usd", "_total").alias("pct_of_total_llm_spend"),
        F.rank().over(W.orderBy(F.desc("failed_llm_cost_usd"))).alias("failure_cost_rank"),
        F.try_divide(
            dbl(F.sum("failed_llm_cost_usd").over(running)) * F.lit(100.0),
            dbl(F.sum("failed_llm_cost_usd").over(W.partitionBy())),
        ).alias("cumulative_pct_of_failed_spend"),
    )
