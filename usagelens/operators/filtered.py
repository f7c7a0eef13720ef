"""Filterable queries. Runs and billing rows are aggregated per customer before they meet the
customer filter, so the filter join moves one row per customer and group, never one per run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import (
    dbl,
    margin,
    month_of,
    months_between_starts,
    paid_only,
    ratio,
    scalar,
    succeeded,
)
from usagelens.functions.ranking import global_rank, quantile_bucket
from usagelens.functions.stats import Z_95, Z_POWER_80, normal_cdf, two_sided_p, wilson_bounds
from usagelens.operators.pricing import arm_counts
from usagelens.operators.reports import assigned_conversions
from usagelens.operators.usage import activation_counts, cost_by_customer_month
from usagelens.schemas import BALANCED_MODEL, FRONTIER_MODEL, MIGRATION_TASK, SIMPLE_TASKS

ACTIVATED_SHARE = 0.6


@dataclass(frozen=True)
class Filters:
    """Validated selections. An empty field means no restriction on that attribute."""

    months: tuple[str, ...] = ()
    plans: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()

    @classmethod
    def build(cls, options: Mapping[str, Iterable[str]], **selected: Iterable[str]) -> Filters:
        """Keep only values on the allow-list of each field; drop the others silently."""
        unknown = set(selected) - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"unknown filter fields: {sorted(unknown)}")
        allowed = {name: set(options[name]) for name in selected}
        return cls(**{name: tuple(v for v in values if v in allowed[name]) for name, values in selected.items()})

    def customer_predicate(self) -> Column | None:
        """Condition on the customers table, or None when nothing is selected."""
        chosen = {"region": self.regions, "acquisition_channel": self.channels, "industry": self.industries}
        parts = [F.col(column).isin(*values) for column, values in chosen.items() if values]
        return _all(parts)

    def month_predicate(self, month: Column | str = "month") -> Column | None:
        month = F.col(month) if isinstance(month, str) else month
        return month.isin(*[dt.date.fromisoformat(m) for m in self.months]) if self.months else None

    def run_month_predicate(self) -> Column | None:
        """The month condition on runs, with a plain time range a scan can use to skip data."""
        if not self.months:
            return None
        chosen = sorted(dt.date.fromisoformat(m) for m in self.months)
        end = (chosen[-1].replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        at = F.col("started_at")
        in_range = (at >= F.lit(chosen[0]).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
        return in_range & self.month_predicate(_run_month())

    def plan_predicate(self, plan: str = "plan") -> Column | None:
        return F.col(plan).isin(*self.plans) if self.plans else None


def _all(parts: Sequence[Column | None]) -> Column | None:
    combined = None
    for part in parts:
        if part is not None:
            combined = part if combined is None else combined & part
    return combined


def _where(frame: DataFrame, *predicates: Column | None) -> DataFrame:
    combined = _all(predicates)
    return frame if combined is None else frame.where(combined)


def selected_customers(customers: DataFrame, filters: Filters) -> DataFrame:
    return _where(customers, filters.customer_predicate())


def of_selected(frame: DataFrame, customers: DataFrame, filters: Filters) -> DataFrame:
    """Rows of selected (and known) customers.

    An inner join on the customer key: a semi join would be pushed below the aggregates that
    feed it and would then shuffle single runs.
    """
    return frame.join(selected_customers(customers, filters).select("customer_id"), "customer_id")


def run_totals(
    runs: DataFrame, customers: DataFrame, filters: Filters, keys: Sequence[str | Column], *restrict: Column | None
) -> DataFrame:
    """Counts, successes, cost and credits of selected customers' runs by ``keys``."""
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    per_customer = (
        _where(runs, *restrict)
        .groupBy("customer_id", *named)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(succeeded()).alias("ok"),
            F.sum("llm_cost_usd").alias("cost"),
            F.sum("credits_charged").alias("credits"),
        )
    )
    groups = [c for c in per_customer.columns if c not in ("customer_id", "n", "ok", "cost", "credits")]
    return (
        of_selected(per_customer, customers, filters)
        .groupBy(*groups)
        .agg(*[F.sum(c).alias(c) for c in ("n", "ok", "cost", "credits")])
    )


def _run_month() -> Column:
    return month_of("started_at")


def _billed_with_cost(months: DataFrame, runs: DataFrame, customers: DataFrame, filters: Filters, *restrict) -> DataFrame:
    billed = of_selected(_where(paid_only(months), *restrict), customers, filters)
    return billed.join(cost_by_customer_month(runs), ["customer_id", "month"], "left").withColumn(
        "llm_cost_usd", F.coalesce("llm_cost_usd", F.lit(0))
    )


def monthly_financials(
    months: DataFrame, runs: DataFrame, customers: DataFrame, filters: Filters = Filters()
) -> DataFrame:
    """MRR, revenue, paid customers, cost and margin per month."""
    rows = _billed_with_cost(
        months, runs, customers, filters, filters.month_predicate(), filters.plan_predicate()
    )
    return (
        rows.groupBy("month")
        .agg(
            F.countDistinct("customer_id").alias("active_paid_customers"),
            F.sum("monthly_fee_usd").alias("mrr"),
            F.sum("revenue_usd").alias("revenue"),
            F.sum("llm_cost_usd").alias("llm_cost"),
        )
        .withColumn("gross_margin", margin("revenue", "llm_cost"))
    )


def run_success_rate(runs: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Success rate and volume per run month."""
    restrict = [filters.run_month_predicate(), filters.plan_predicate("plan_at_run")]
    totals = run_totals(runs, customers, filters, [_run_month().alias("month")], *restrict)
    return totals.select("month", ratio("ok", "n").alias("success_rate"), F.col("n").alias("n_runs"))


def nrr_average(months: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Unweighted mean of revenue ratios over consecutive months present in the data."""
    rows = of_selected(_where(paid_only(months), filters.month_predicate()), customers, filters).select(
        "customer_id", "month", "revenue_usd"
    )
    # the months present, as one sorted array: a join on month would put each month into one task
    calendar = scalar(rows.agg(F.sort_array(F.collect_set("month")).alias("c")), "c")
    position = F.array_position("calendar", F.col("month")).cast("int")
    timeline = W.partitionBy("customer_id").orderBy("month")
    pairs = (
        rows.withColumn("_then", F.lead("month").over(timeline))
        .withColumn("_later", F.lead("revenue_usd").over(timeline))
        .withColumn("calendar", calendar)
        .withColumn("next_month", F.get("calendar", position))
        .where(F.col("next_month").isNotNull() & (F.col("revenue_usd") > 0))
        .groupBy("month")
        .agg(
            ratio(
                F.sum(F.when(F.col("_then") == F.col("next_month"), F.col("_later")).otherwise(F.lit(0))),
                F.sum("revenue_usd"),
            ).alias("r")
        )
    )
    return pairs.agg(F.avg("r").alias("nrr"))


def cohort_retention_any(months: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Customers billed on any plan by signup cohort and months since signup."""
    cohorts = selected_customers(customers, filters).select(
        "customer_id", month_of("signup_date").alias("cohort_month")
    )
    rows = _where(months, filters.month_predicate()).select("customer_id", "month").join(cohorts, "customer_id")
    sizes = rows.groupBy("cohort_month").agg(F.countDistinct("customer_id").alias("cohort_size"))
    active = rows.groupBy(
        "cohort_month", months_between_starts("month", "cohort_month").alias("months_since_signup")
    ).agg(F.countDistinct("customer_id").alias("active"))
    return active.join(sizes, "cohort_month").withColumn("retention", ratio("active", "cohort_size"))


def activation_by_customer(runs: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Activation, self-serve conversion and retention flag per customer."""
    activated = activation_counts(runs).select(
        "customer_id", (ratio("successes", "runs_considered") >= ACTIVATED_SHARE).alias("activated")
    )
    return (
        selected_customers(customers, filters)
        .select("customer_id", "is_sales_led", "first_paid_date", "status", "acquisition_channel")
        .join(activated, "customer_id", "left")
        .withColumn("activated", F.coalesce("activated", F.lit(False)))
        .withColumn("self_serve_converted", F.col("first_paid_date").isNotNull() & (F.col("is_sales_led") == 0))
        .withColumn("retained", F.col("status") == "active")
    )


def _share(condition: str) -> Column:
    return ratio(F.count_if(F.col(condition)), F.count(F.lit(1)))


def channel_summary(runs: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Self-serve customers per channel with conversion, retention and activation rates."""
    return (
        activation_by_customer(runs, customers, filters)
        .where(F.col("is_sales_led") == 0)
        .groupBy("acquisition_channel")
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            _share("self_serve_converted").alias("conversion_rate"),
            _share("retained").alias("retention_rate"),
            _share("activated").alias("activation_rate"),
        )
    )


def model_task_success(runs: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Success rate, mean cost and volume by model and task."""
    totals = run_totals(runs, customers, filters, ["model", "task_type"], filters.run_month_predicate())
    return totals.select(
        "model",
        "task_type",
        ratio("ok", "n").alias("success_rate"),
        ratio("cost", "n").alias("avg_cost"),
        F.col("n").alias("n_runs"),
    )


def cost_per_success(runs: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Total cost over number of successes, per model."""
    return run_totals(runs, customers, filters, ["model"]).select(
        "model",
        F.col("cost").alias("total_cost"),
        F.col("ok").alias("n_success"),
        F.col("n").alias("n_runs"),
        ratio("cost", "ok").alias("cost_per_success"),
    )


def migration_pairs(runs: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Success and cost per migration pair."""
    totals = run_totals(
        runs, customers, filters, ["source_stack", "target_stack"], F.col("task_type") == MIGRATION_TASK
    )
    return totals.select(
        "source_stack",
        "target_stack",
        ratio("ok", "n").alias("success_rate"),
        ratio("cost", "n").alias("avg_cost"),
        F.col("n").alias("n_runs"),
    )


def executive_kpis(
    months: DataFrame, runs: DataFrame, customers: DataFrame, filters: Filters = Filters()
) -> DataFrame:
    """Latest month against the one before; relative change, or points for rates."""
    by_month = W.orderBy("month")

    def relative(column: str) -> Column:
        before = F.lag(column).over(by_month)
        return F.try_divide(dbl(column) - dbl(before), dbl(before)).alias(f"{column}_change")

    def points(column: str) -> Column:
        return ((F.col(column) - F.lag(column).over(by_month)) * 100).alias(f"{column}_change_pp")

    money = ["mrr", "revenue", "active_paid_customers"]
    financials = monthly_financials(months, runs, customers, filters).select(
        "month", *money, "gross_margin", *[relative(c) for c in money], points("gross_margin")
    )
    success = run_success_rate(runs, customers, filters).select(
        "month", "success_rate", points("success_rate")
    )
    latest = success.agg(F.max_by(F.struct("success_rate", "success_rate_change_pp"), "month").alias("s"))
    last_row = F.struct(*[F.col(c) for c in financials.columns])
    return (
        financials.agg(F.max_by(last_row, "month").alias("f"))
        .where(F.col("f").isNotNull())
        .withColumn("s", scalar(latest, "s"))
        .select("f.*", "s.*", scalar(nrr_average(months, customers, filters), "nrr").alias("nrr"))
    )


def failure_tax(runs: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Cost of every run that did not succeed; zeros when there is nothing to share."""
    flagged = runs.withColumn("good", succeeded())
    totals = run_totals(flagged, customers, filters, ["good"])
    bad = ~F.col("good")
    summed = totals.agg(
        F.sum(F.when(bad, F.col("cost"))).alias("failed"),
        F.sum("cost").alias("total"),
        F.sum(F.when(bad, F.col("n"))).alias("n_bad"),
        F.sum("n").alias("n_all"),
    )
    spent = F.coalesce(F.col("total") != 0, F.lit(False))

    def unless_empty(column: str, kind: str) -> Column:
        return F.when(spent, F.coalesce(F.col(column), F.lit(0))).otherwise(F.lit(0)).cast(kind)

    return summed.select(
        unless_empty("failed", "double").alias("failed_cost"),
        unless_empty("total", "double").alias("total_cost"),
        F.coalesce(ratio(F.coalesce("failed", F.lit(0)), "total"), F.lit(0.0)).alias("share"),
        unless_empty("n_bad", "long").alias("n_failed"),
        unless_empty("n_all", "long").alias("n_runs"),
    )


def margin_by_plan(
    months: DataFrame, runs: DataFrame, customers: DataFrame, filters: Filters = Filters()
) -> DataFrame:
    """Revenue, cost and margin per paid plan of the selected customers."""
    rows = _billed_with_cost(months, runs, customers, filters)
    return (
        rows.groupBy("plan")
        .agg(F.sum("revenue_usd").alias("revenue"), F.sum("llm_cost_usd").alias("llm_cost"))
        .withColumn("gross_margin", margin("revenue", "llm_cost"))
    )


def team_revenue_per_credit(months: DataFrame, customers: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """D14 reference line: Team revenue per credit used; NULL without credits."""
    team = of_selected(months.where(F.col("plan") == "Team"), customers, filters)
    return team.agg(ratio(F.sum("revenue_usd"), F.sum("credits_used")).alias("team_revenue_per_credit"))


def cost_per_credit_by_task(
    runs: DataFrame, months: DataFrame, customers: DataFrame, filters: Filters = Filters()
) -> DataFrame:
    """Cost per credit by task and whether it lies above the Team reference line."""
    line = scalar(team_revenue_per_credit(months, customers, filters), "team_revenue_per_credit")
    return (
        run_totals(runs, customers, filters, ["task_type"])
        .select(
            "task_type",
            F.col("cost").alias("total_cost"),
            F.col("credits").alias("total_credits"),
            F.col("n").alias("n_runs"),
            ratio("cost", "credits").alias("cost_per_credit"),
        )
        .withColumn("team_revenue_per_credit", line)
        .withColumn("above_team_line", F.col("cost_per_credit") > F.col("team_revenue_per_credit"))
    )


def margin_deciles(
    months: DataFrame, runs: DataFrame, customers: DataFrame, filters: Filters = Filters()
) -> DataFrame:
    """Margin per customer on the cost of its paid months, with margin decile."""
    per_customer = (
        _billed_with_cost(months, runs, customers, filters)
        .groupBy("customer_id")
        .agg(F.sum("revenue_usd").alias("revenue"), F.sum("llm_cost_usd").alias("llm_cost"))
        .where(F.col("revenue") > 0)
        .withColumn("gross_margin", margin("revenue", "llm_cost"))
    )
    return (
        global_rank(per_customer, ["gross_margin", "customer_id"])
        .withColumn("decile", quantile_bucket(10))
        .drop("_rank", "_n")
    )


def margin_decile_summary(deciles: DataFrame) -> DataFrame:
    """Mean margin per decile and the number of deciles with a negative mean."""
    means = deciles.groupBy("decile").agg(
        F.avg("gross_margin").alias("avg_margin"), F.count(F.lit(1)).alias("customers")
    )
    return means.withColumn("negative_deciles", F.count_if(F.col("avg_margin") < 0).over(W.partitionBy()))


def experiment_conversion(assignments: DataFrame, customers: DataFrame, experiment: str) -> DataFrame:
    """Assigned customers and conversions within 0..30 days per variant."""
    return (
        assigned_conversions(assignments, customers, experiment, min_days=0)
        .groupBy("variant")
        .agg(F.countDistinct("customer_id").alias("n"), F.sum("converted").alias("conversions"))
    )


def experiment_readout(assignments: DataFrame, customers: DataFrame, experiment: str) -> DataFrame:
    """Wilson intervals, pooled z, p-value, minimum detectable effect and achieved power."""
    counts = arm_counts(assigned_conversions(assignments, customers, experiment, min_days=0))
    p1, p2 = F.col("p1"), F.col("p2")
    pooled = ratio(F.col("x1") + F.col("x2"), F.col("n1") + F.col("n2"))
    se = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), "n1") + ratio(F.lit(1), "n2")))
    mean_n, mean_p = (F.col("n1") + F.col("n2")) / 2, (p1 + p2) / 2
    spread = F.sqrt(F.try_divide(2 * mean_p * (1 - mean_p), mean_n))
    low1, high1 = wilson_bounds("x1", "n1", Z_95)
    low2, high2 = wilson_bounds("x2", "n2", Z_95)
    return (
        counts.withColumn("p1", ratio("x1", "n1"))
        .withColumn("p2", ratio("x2", "n2"))
        .withColumn("z_statistic", F.coalesce(F.try_divide(p1 - p2, se), F.lit(0.0)))
        .select(
            F.col("n1").alias("n_control"),
            F.col("n2").alias("n_treatment"),
            p1.alias("conversion_control"),
            p2.alias("conversion_treatment"),
            low1.alias("control_ci_low"),
            high1.alias("control_ci_high"),
            low2.alias("treatment_ci_low"),
            high2.alias("treatment_ci_high"),
            "z_statistic",
            two_sided_p(F.col("z_statistic")).alias("p_value"),
            ((Z_95 + Z_POWER_80) * spread).alias("minimum_detectable_effect"),
            normal_cdf(F.try_divide(F.abs(p1 - p2), spread) - Z_95).alias("achieved_power"),
        )
    )


def simple_task_frontier_stats(
    runs: DataFrame, customers: DataFrame, filters: Filters = Filters(), simple_tasks: Sequence[str] = SIMPLE_TASKS
) -> DataFrame:
    """Success and cost of the frontier and balanced models on simple tasks."""
    simple = F.col("task_type").isin(*simple_tasks) & F.col("model").isin(FRONTIER_MODEL, BALANCED_MODEL)
    totals = run_totals(runs, customers, filters, ["task_type", "model"], simple)
    return totals.select(
        "task_type",
        "model",
        ratio("ok", "n").alias("success_rate"),
        ratio("cost", "n").alias("avg_cost"),
        F.col("n").alias("n_runs"),
    )


def routing_what_if(
    runs: DataFrame,
    customers: DataFrame,
    filters: Filters = Filters(),
    percents: Sequence[int] = tuple(range(0, 101, 5)),
) -> DataFrame:
    """Savings and success when a share of frontier runs on simple tasks moves to balanced.

    Terms of a task without balanced runs contribute 0 to the moved part.
    """
    stats = simple_task_frontier_stats(runs, customers, filters)

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    tasks = stats.groupBy("task_type").agg(
        F.coalesce(of(FRONTIER_MODEL, "n_runs"), F.lit(0)).alias("n"),
        of(FRONTIER_MODEL, "avg_cost").alias("cost"),
        of(FRONTIER_MODEL, "success_rate").alias("rate"),
        of(BALANCED_MODEL, "avg_cost").alias("other_cost"),
        of(BALANCED_MODEL, "success_rate").alias("other_rate"),
    )
    n = dbl("n")
    weighted = tasks.agg(
        *[
            F.coalesce(F.sum(n * F.col(c)), F.lit(0.0)).alias(c)
            for c in ("cost", "rate", "other_cost", "other_rate")
        ],
        F.sum("n").alias("n"),
    )
    moved = F.col("pct") / F.lit(100.0)
    return (
        weighted.select("*", F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("pct"))
        .withColumn("new_cost_usd", F.col("cost") * (1 - moved) + F.col("other_cost") * moved)
        .withColumn("new_ok", F.col("rate") * (1 - moved) + F.col("other_rate") * moved)
        .select(
            "pct",
            F.col("cost").alias("current_cost_usd"),
            "new_cost_usd",
            (F.col("cost") - F.col("new_cost_usd")).alias("savings_usd"),
            ratio("rate", "n").alias("current_success_rate"),
            ratio("new_ok", "n").alias("new_success_rate"),
        )
    )
