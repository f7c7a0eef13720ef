"""Data-quality rules as one report: rule name and number of violations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import is_paid, margin, ratio, scalar
from usagelens.operators.usage import billing_with_cost, success_rate
from usagelens.schemas import ALL_PLANS, STATUSES

RUN_MEASURES = [
    "llm_cost_usd", "input_tokens", "output_tokens", "steps", "latency_sec", "lines_changed", "credits_charged",
]
BILLING_MEASURES = ["credits_used", "overage_credits", "overage_revenue_usd", "monthly_fee_usd"]


def _as_rows(counted: DataFrame) -> DataFrame:
    """One row of counters, named by rule, as one row per rule; nothing counted is no violation."""
    count_of = lambda rule: F.coalesce(F.col(rule), F.lit(0)).cast("long").alias("violations")
    return counted.select(
        F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), count_of(rule)) for rule in counted.columns])).alias("r")
    ).select("r.*")


def _one(frame: DataFrame, rule: str) -> DataFrame:
    """The number of rows of ``frame`` as the violations of ``rule``."""
    return frame.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def duplicates(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _no_negative(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) >= 0 for c in columns])


def _not_proven(good: Column) -> Column:
    """A rule is broken unless its condition is true: a missing value proves nothing."""
    return ~F.coalesce(good, F.lit(False))


def _known_customers(customers: DataFrame) -> DataFrame:
    """One row per customer id: its rows, whether a row is not proven self-serve, and its distinct lifetimes with their counts."""
    lifetimes = customers.groupBy("customer_id", "signup_date", "churn_date").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(_not_proven(F.col("is_sales_led") == 0)).alias("led")
    )
    return lifetimes.groupBy("customer_id").agg(
        F.sum("n").alias("customer_rows"),
        F.bool_or("led").alias("sales_led"),
        F.collect_list(F.struct("signup_date", "churn_date", "n")).alias("lifetimes"),
    )


def _run_rules(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Q03, Q07-Q10, Q13, Q14 from one pass with counters per customer and day.

    A day tells whether a run lies before signup or after churn, so a customer's runs shrink to one entry per calendar day
    before they meet the customer's lifetimes.
    """
    tests_good = (F.col("tests_passed") >= 0) & (F.col("tests_passed") <= F.col("tests_total"))
    row_rules = {
        "q07_run_measures_non_negative": _not_proven(_no_negative(RUN_MEASURES)),
        "q08_tests_passed_within_total": _not_proven(tests_good),
        "q09_rating_between_1_and_5": ~F.col("human_rating").between(1, 5),
        "q10_known_status": _not_proven(F.col("status").isin(*STATUSES)),
    }
    day = F.to_date("started_at")
    per_day = (
        runs.withColumn("day", day)
        .groupBy("customer_id", "day")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("started_at") == F.col("day").cast("timestamp_ntz")).alias("at_midnight"),
            *[F.count_if(condition).alias(rule) for rule, condition in row_rules.items()],
        )
    )
    per_customer = per_day.groupBy("customer_id").agg(
        *[F.sum(rule).alias(rule) for rule in row_rules],
        F.collect_list(F.struct("day", "n", "at_midnight")).alias("days"),
    )

    def over_days(faults) -> Column:
        """Sum of ``faults(day, lifetime)`` over a customer's days and lifetimes."""
        total = lambda items, value: F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + value(x))
        return total(F.col("lifetimes"), lambda life: life["n"] * total(F.col("days"), lambda d: faults(d, life)))

    def before_signup(d: Column, life: Column) -> Column:
        return F.when(d["day"] >= life["signup_date"], 0).otherwise(d["n"])

    def after_churn(d: Column, life: Column) -> Column:
        # the churn date is the last active day, so one day of slack from its midnight
        limit = F.date_add(life["churn_date"], 1)
        in_time = life["churn_date"].isNull() | (d["day"] < limit)
        return (
            F.when(d["day"].isNull(), d["n"]).when(in_time, 0).when(d["day"] == limit, d["n"] - d["at_midnight"]).otherwise(d["n"])
        )

    return _as_rows(
        per_customer.join(known.select("customer_id", "lifetimes"), "customer_id", "left").agg(
            F.count_if(F.col("lifetimes").isNull()).alias("q03_runs_have_customer"),
            *[F.sum(rule).alias(rule) for rule in row_rules],
            F.sum(over_days(before_signup)).alias("q13_runs_not_before_signup"),
            F.sum(over_days(after_churn)).alias("q14_runs_not_after_churn"),
        )
    )


def _billing_rules(months: DataFrame, known: DataFrame) -> DataFrame:
    """Q04, Q06, Q11, Q12, Q15 from one pass over the billing rows."""
    gap = F.abs(F.col("revenue_usd") - F.col("monthly_fee_usd") - F.col("overage_revenue_usd"))
    free = (F.col("monthly_fee_usd") == 0) & (F.col("overage_revenue_usd") == 0)
    row_rules = {
        "q11_billing_measures_non_negative": _not_proven(_no_negative(BILLING_MEASURES)),
        "q12_revenue_is_fee_plus_overage": gap >= 1e-6,
        "q15_free_plan_costs_nothing": _not_proven(is_paid() | free),
    }
    per_month = months.groupBy("customer_id", "month").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(condition).alias(rule) for rule, condition in row_rules.items()]
    )
    per_customer = per_month.groupBy("customer_id").agg(
        F.count_if(F.col("n") > 1).alias("repeated"), *[F.sum(rule).alias(rule) for rule in row_rules]
    )
    return _as_rows(
        per_customer.join(known.select("customer_id", "customer_rows"), "customer_id", "left").agg(
            F.count_if(F.col("customer_rows").isNull()).alias("q04_months_have_customer"),
            F.sum("repeated").alias("q06_one_row_per_customer_month"),
            *[F.sum(rule).alias(rule) for rule in row_rules],
        )
    )


def _assignment_rules(
    assignments: DataFrame, known: DataFrame, window: tuple[str, str], prices: Mapping[str, int]
) -> DataFrame:
    """Q05, Q16-Q18 from one pass over the assignments."""
    expected_price = reduce(
        lambda chain, item: chain.when(F.col("variant") == item[0], item[1]), list(prices.items()), F
    )
    row_rules = {
        "q17_assigned_within_window": _not_proven(F.col("assigned_at").between(*window)),
        "q18_price_matches_variant": _not_proven(F.col("pro_price_shown") == expected_price),
    }
    per_customer = assignments.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(condition).alias(rule) for rule, condition in row_rules.items()]
    )
    return _as_rows(
        per_customer.join(known.select("customer_id", "sales_led"), "customer_id", "left").agg(
            F.count_if(F.col("sales_led").isNull()).alias("q05_assignments_have_customer"),
            F.sum(F.when(F.col("sales_led"), F.col("n"))).alias("q16_assignments_are_self_serve"),
            *[F.sum(rule).alias(rule) for rule in row_rules],
        )
    )


def quality_report(
    customers: DataFrame,
    runs: DataFrame,
    months: DataFrame,
    assignments: DataFrame,
    window: tuple[str, str],
    prices: Mapping[str, int],
) -> DataFrame:
    """Q01-Q18, each table read in one pass that keeps counters per key.

    The run ids alone take a second, narrow pass: as grouping sets of one pass every run id would carry the other rules'
    counters through the exchange, which took longer than reading one column again.
    Key rules count distinct offending keys, others count rows; what is not proven good is counted.
    A missing rating is allowed, and the revenue sum skips missing amounts.
    """
    known = _known_customers(customers)
    repeated = known.agg(F.count_if(F.col("customer_rows") > 1).alias("q01_customer_id_unique"))
    return _union(
        [
            _as_rows(repeated),
            _one(duplicates(runs, "run_id"), "q02_run_id_unique"),
            _run_rules(runs, known),
            _billing_rules(months, known),
            _assignment_rules(assignments, known, window, prices),
        ]
    )


STAR_KEYS = {
    "dim_customer": "customer_key",
    "dim_plan": "plan_key",
    "dim_model": "model_key",
    "dim_task": "task_key",
    "dim_date": "date_key",
}
STAR_FACTS = {
    "fact_agent_runs": ["customer_key", "plan_key", "model_key", "task_key", "date_key"],
    "fact_customer_month": ["customer_key", "plan_key", "date_key"],
}


def star_quality(star: Mapping[str, DataFrame], sources: Mapping[str, DataFrame]) -> DataFrame:
    """Q19: key uniqueness, resolution of every foreign key, kept row counts and a calendar without gaps."""
    dims = {key: star[name] for name, key in STAR_KEYS.items()}
    checks = [_one(duplicates(star[name], key), f"q19_{name}_key_unique") for name, key in STAR_KEYS.items()]
    for fact, keys in STAR_FACTS.items():
        # every key combination once: the fact is read a single time for all of its keys
        used = (
            star[fact]
            .select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("long").alias("v")) for k in keys])).alias("x"))
            .select("x.*")
            .distinct()
        )
        known = _union([dims[k].select(F.lit(k).alias("k"), F.col(k).cast("long").alias("v")) for k in keys])
        missing = used.join(known, ["k", "v"], "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("c"))
        summed = missing.agg(
            *[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("c"))), F.lit(0)).alias(k) for k in keys]
        )
        checks.append(
            summed.select(
                F.explode(
                    F.array(
                        *[
                            F.struct(F.lit(f"q19_{fact}_{k}_resolves").alias("rule"), F.col(k).alias("violations"))
                            for k in keys
                        ]
                    )
                ).alias("r")
            ).select("r.*")
        )
    for name, source in sources.items():
        rows = scalar(source.agg(F.count(F.lit(1)).alias("n")), "n")
        checks.append(
            star[name].agg(F.lit(f"q19_{name}_row_count").alias("rule"), F.abs(F.count(F.lit(1)) - rows).alias("violations"))
        )
    days = star["dim_date"].select("date", F.lag("date").over(W.orderBy("date")).alias("before"))
    checks.append(_one(days.where(F.datediff("date", "before") != 1), "q19_dim_date_without_gaps"))
    return _union(checks)


def dataset_summary(
    customers: DataFrame, runs: DataFrame, months: DataFrame, assignments: DataFrame
) -> DataFrame:
    """Q20: one row of counts, rates and margins (overall and per plan)."""
    per_plan = (
        billing_with_cost(months, runs)
        .groupBy("plan")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("revenue_usd").alias("revenue"), F.sum("llm_cost_usd").alias("cost")
        )
    )
    billing = per_plan.agg(
        F.sum("n").alias("n_customer_months"),
        F.sum(F.when(is_paid(), F.col("n"))).alias("paid_months"),
        F.sum("revenue").alias("revenue"),
        *[
            F.max(F.when(F.col("plan") == plan, margin("revenue", "cost"))).alias(f"gross_margin_{plan.lower()}")
            for plan in ALL_PLANS
        ],
    )
    people = customers.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.count_if(F.col("is_sales_led") == 0).alias("self_serve"),
        (F.count("first_paid_date") - F.count_if(F.col("is_sales_led") == 1)).alias("converted"),
        F.count_if((F.col("status") == "churned") & F.col("first_paid_date").isNotNull()).alias("churned"),
    )
    usage = runs.agg(
        F.count(F.lit(1)).alias("n_runs"), success_rate().alias("success_rate"), F.sum("llm_cost_usd").alias("cost")
    )
    assigned = assignments.agg(F.count(F.lit(1)).alias("n"))
    person = scalar(people.select(F.struct("*").alias("p")), "p")
    run = scalar(usage.select(F.struct("*").alias("u")), "u")
    return (
        billing.withColumn("p", person)
        .withColumn("u", run)
        .select(
            F.col("p.n_customers"),
            "n_customer_months",
            F.col("u.n_runs"),
            scalar(assigned, "n").alias("n_assignments"),
            F.col("u.success_rate"),
            margin("revenue", F.col("u.cost")).alias("gross_margin"),
            *[f"gross_margin_{plan.lower()}" for plan in ALL_PLANS],
            ratio(F.col("p.converted"), F.col("p.self_serve")).alias("conversion_rate"),
            ratio(F.col("p.churned"), "paid_months").alias("paid_churn_rate"),
        )
    )
