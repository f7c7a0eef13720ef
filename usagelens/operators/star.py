"""Star schema: five dimensions, two facts and the measures defined on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import is_paid, margin, ratio, scalar, succeeded, sum_where
from usagelens.functions.ranking import global_rank
from usagelens.operators.usage import WINDOW_SIZE, billing_with_cost, success_rate
from usagelens.schemas import SIMPLE_TASKS
from usagelens.sources.sinks import sanitize_text


def date_key(day: Column | str) -> Column:
    """yyyymmdd as an integer."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def dim_customer(customers: DataFrame) -> DataFrame:
    """Dense key 1..n in customer id order, assigned range by range."""
    columns = [
        "customer_id", "company_name", "signup_date", "industry", "company_size", "region", "acquisition_channel",
        "is_sales_led", "first_paid_date", "current_plan", "churn_date", "status",
    ]
    keyed = global_rank(customers.select(*columns), ["customer_id"], rank="customer_key").select(
        "customer_key", *columns
    )
    text = ["company_name", "industry", "company_size", "region", "acquisition_channel", "current_plan", "status"]
    return sanitize_text(keyed, text)


def _small_key(frame: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Running key of a table whose size is the number of plans, models or tasks."""
    return frame.select(F.row_number().over(W.orderBy(*order)).alias(key), *frame.columns)


def dim_plan(plans: DataFrame) -> DataFrame:
    """S02."""
    return sanitize_text(_small_key(plans, "plan_key", "monthly_fee_usd", "plan"), ["plan"])


def dim_model(models: DataFrame) -> DataFrame:
    """S03."""
    return sanitize_text(_small_key(models, "model_key", F.desc("usd_per_m_input"), "model"), ["model"])


def dim_task(runs: DataFrame, simple_tasks: Sequence[str] = SIMPLE_TASKS) -> DataFrame:
    """Distinct tasks in alphabetical order."""
    tasks = _small_key(runs.select("task_type").distinct(), "task_key", "task_type")
    simple = F.col("task_type").isin(*simple_tasks).cast("int")
    return sanitize_text(tasks.withColumn("is_simple_task", simple), ["task_type"])


def dim_date(runs: DataFrame, months: DataFrame, customers: DataFrame) -> DataFrame:
    """Every day from the first to the last month any table mentions."""

    def span(frame: DataFrame, *columns: str) -> DataFrame:
        days = [F.to_date(c) for c in columns]
        low = F.least(*[F.min(d) for d in days]) if len(days) > 1 else F.min(days[0])
        high = F.greatest(*[F.max(d) for d in days]) if len(days) > 1 else F.max(days[0])
        return frame.agg(low.alias("low"), high.alias("high"))

    spans = span(runs, "started_at").unionByName(span(months, "month")).unionByName(
        span(customers, "signup_date", "churn_date")
    )
    bounds = spans.agg(F.trunc(F.min("low"), "month").alias("a"), F.last_day(F.max("high")).alias("b"))
    day = F.col("date")
    return (
        bounds.where(F.col("a").isNotNull())
        .select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date"))
        .select(
            date_key(day).alias("date_key"),
            day,
            F.year(day).alias("year"),
            F.quarter(day).alias("quarter"),
            F.month(day).alias("month"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.trunc(day, "month").alias("month_start"),
            F.dayofmonth(day).alias("day"),
            F.date_format(day, "EEEE").alias("day_of_week"),
            (F.dayofmonth(day) == 1).cast("int").alias("is_month_start"),
        )
    )


def _with_key(fact: DataFrame, dim: DataFrame, key: str, natural: str, fact_column: str, labels: bool = False) -> DataFrame:
    """``labels``: the dimension has one row per plan, model or task, so it is sent to the facts, not they to it."""
    keys = dim.select(key, F.col(natural).alias(fact_column))
    return fact.join(F.broadcast(keys) if labels else keys, fact_column, "left")


def fact_agent_runs(
    runs: DataFrame, customer_dim: DataFrame, plan_dim: DataFrame, model_dim: DataFrame, task_dim: DataFrame
) -> DataFrame:
    """Runs with surrogate keys.

    A shuffle by plan, model or task would put all runs into as many tasks as there are labels. Runs that
    already carry ``customer_key`` keep it; others are joined to the customers.
    """
    keyed = _with_key(runs, plan_dim, "plan_key", "plan", "plan_at_run", labels=True)
    keyed = _with_key(keyed, model_dim, "model_key", "model", "model", labels=True)
    keyed = _with_key(keyed, task_dim, "task_key", "task_type", "task_type", labels=True)
    if "customer_key" not in keyed.columns:
        keyed = _with_key(keyed, customer_dim, "customer_key", "customer_id", "customer_id")
    ordered = keyed.select(
        "run_id", "customer_key", date_key("started_at").alias("date_key"), "plan_key", "model_key", "task_key",
        "started_at", "source_stack", "target_stack", "steps", "input_tokens", "output_tokens", "llm_cost_usd",
        "latency_sec", "lines_changed", "tests_total", "tests_passed", "status", "credits_charged", "human_rating",
    )
    return sanitize_text(ordered, ["run_id", "source_stack", "target_stack", "status"])


def fact_customer_month(
    months: DataFrame, runs: DataFrame, customer_dim: DataFrame, plan_dim: DataFrame
) -> DataFrame:
    """Billing rows with run cost and surrogate keys."""
    keyed = _with_key(billing_with_cost(months, runs), customer_dim, "customer_key", "customer_id", "customer_id")
    keyed = _with_key(keyed, plan_dim, "plan_key", "plan", "plan", labels=True)
    return keyed.select(
        "customer_key", date_key("month").alias("date_key"), "plan_key", "monthly_fee_usd", "included_credits",
        "credits_used", "overage_credits", "overage_revenue_usd", "revenue_usd", "llm_cost_usd",
    )


def star_schema(
    customers: DataFrame, plans: DataFrame, models: DataFrame, months: DataFrame, runs: DataFrame,
    keyed_runs: Callable[[DataFrame], DataFrame] | None = None, customer_dim: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All seven tables; the dimensions are shared by the facts. ``keyed_runs`` gives the runs with the key of a customer
    dimension, ``customer_dim`` is the dimension of ``customers`` if there is one."""
    plan_dim, model_dim = dim_plan(plans), dim_model(models)
    customer_dim = dim_customer(customers) if customer_dim is None else customer_dim
    task_dim = dim_task(runs)
    return {
        "dim_customer": customer_dim,
        "dim_plan": plan_dim,
        "dim_model": model_dim,
        "dim_task": task_dim,
        "dim_date": dim_date(runs, months, customers),
        "fact_agent_runs": fact_agent_runs(keyed_runs(customer_dim) if keyed_runs else runs, customer_dim, plan_dim, model_dim, task_dim),
        "fact_customer_month": fact_customer_month(months, runs, customer_dim, plan_dim),
    }


def star_monthly_measures(fact_months: DataFrame, plan_dim: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """S08 per month: MRR, gross margin and NRR against the MRR twelve months earlier of ever-paid customers."""
    ever_paid = customer_dim.select("customer_key", F.col("first_paid_date").isNotNull().alias("ever_paid"))
    labelled = fact_months.join(plan_dim.select("plan_key", "plan"), "plan_key").join(
        ever_paid, "customer_key"
    )
    fee = F.col("monthly_fee_usd")
    by_month = labelled.groupBy(F.to_date(F.col("date_key").cast("string"), "yyyyMMdd").alias("month")).agg(
        sum_where(is_paid(), fee).alias("mrr_usd"),
        sum_where(is_paid(), "revenue_usd").alias("revenue_usd"),
        sum_where(is_paid(), "llm_cost_usd").alias("llm_cost_usd"),
        sum_where(is_paid() & F.col("ever_paid"), fee).alias("_base"),
    )
    # one row per month: the row of twelve months before, if there is one
    year_ago = W.orderBy(F.year("month") * 12 + F.month("month")).rangeBetween(-12, -12)
    return by_month.select(
        "month",
        "mrr_usd",
        margin("revenue_usd", "llm_cost_usd").alias("gross_margin"),
        ratio("mrr_usd", F.max("_base").over(year_ago)).alias("nrr"),
    )


def star_run_measures(fact_runs: DataFrame) -> DataFrame:
    """S08 over all runs: success rate, cost per success and activation rate (time ties share a rank).

    Runs are counted per customer and second first, so a second with a million runs is one row. The runs of rank 1 to
    ``WINDOW_SIZE`` lie in a customer's first ``WINDOW_SIZE`` seconds with a run, a top-k that Spark takes per task.
    """
    in_time = W.partitionBy("customer_key").orderBy("started_at")
    before = F.coalesce(F.sum("n").over(in_time.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = (
        fact_runs.groupBy("customer_key", "started_at")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(succeeded()).alias("ok"))
        .withColumn("r", F.row_number().over(in_time))
        .where(F.col("r") <= WINDOW_SIZE)
        .withColumn("before", before)
        .where(F.col("before") < WINDOW_SIZE)
        .groupBy("customer_key")
        .agg(ratio(F.sum("ok"), F.sum("n")).alias("share"))
        .agg(ratio(F.count_if(F.col("share") >= 0.6), F.count(F.lit(1))).alias("activation_rate"))
    )
    return fact_runs.agg(
        success_rate().alias("success_rate"),
        ratio(F.sum("llm_cost_usd"), F.count_if(succeeded())).alias("cost_per_success_usd"),
    ).withColumn("activation_rate", scalar(first, "activation_rate"))
