"""Headline numbers and chart-ready tables derived from the report frames (all small)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import dense, dbl, ratio, scalar
from usagelens.functions.stats import format_p
from usagelens.operators.pricing import arm_counts

MAX_LOOKBACK = 6


def _best(order: Column, columns: Sequence[str], largest: bool = True) -> Column:
    """The row (as a struct) with the largest or smallest ``order``; give a struct to break ties."""
    pick = F.max_by if largest else F.min_by
    return pick(F.struct(*columns), order)


def headline_growth(kpis: DataFrame, retention: DataFrame) -> DataFrame:
    """M01 from R01 and R02: MRR, ARR, trailing growth rate, net-new MRR, customers, mean NRR."""
    everything = W.partitionBy()
    back = F.least(F.lit(MAX_LOOKBACK), F.col("n") - 1)
    numbered = (
        kpis.withColumn("i", F.row_number().over(W.orderBy("month")))
        .withColumn("n", F.count(F.lit(1)).over(everything))
        .withColumn("lookback", back)
    )
    latest = F.col("i") == F.col("n")
    mrr = dbl("mrr_usd")
    ends = numbered.agg(
        F.max(F.when(latest, F.col("month"))).alias("month"),
        F.max(F.when(latest, mrr)).alias("mrr_usd"),
        F.max(F.when(F.col("i") == F.col("n") - F.col("lookback"), mrr)).alias("past"),
        F.max("lookback").alias("lookback_months"),
        F.max(F.when(latest, F.col("active_paid_customers"))).alias("active_paid_customers"),
    )
    growth = F.pow(F.try_divide(F.col("mrr_usd"), F.col("past")), ratio(F.lit(1), "lookback_months"))
    return ends.select(
        "month",
        "mrr_usd",
        (F.col("mrr_usd") * 12).alias("arr_usd"),
        "lookback_months",
        ((growth - 1) * 100).alias("trailing_cmgr_pct"),
        (F.col("mrr_usd") - F.col("past")).alias("net_new_mrr_usd"),
        "active_paid_customers",
        scalar(retention.agg(F.avg("nrr_pct").alias("a")), "a").alias("mean_nrr_pct"),
    )


def headline_margins(plans: DataFrame, pairs: DataFrame, tasks: DataFrame) -> DataFrame:
    """M02 from P01, R07 and R09: worst and best plan, worst migration pair, worst task."""
    m = F.struct("gross_margin_pct", "plan")
    worst_pair = pairs.agg(
        _best(F.struct("llm_cost_per_credit_usd", "migration_pair"), ["migration_pair", "llm_cost_per_credit_usd"]).alias("x")
    )
    worst_task = tasks.agg(
        _best(F.struct("margin_per_credit_usd", "task_type"), ["task_type", "margin_per_credit_usd"], False).alias("x")
    )
    return (
        plans.where(F.col("gross_margin_pct").isNotNull())
        .agg(_best(m, ["plan", "gross_margin_pct"], False).alias("w"), _best(m, ["plan", "gross_margin_pct"]).alias("b"))
        .withColumn("p", scalar(worst_pair, "x"))
        .withColumn("t", scalar(worst_task, "x"))
        .select(
            F.col("w.plan").alias("worst_plan"),
            F.col("w.gross_margin_pct").alias("worst_margin_pct"),
            F.col("b.plan").alias("best_plan"),
            F.col("b.gross_margin_pct").alias("best_margin_pct"),
            (F.col("b.gross_margin_pct") - F.col("w.gross_margin_pct")).alias("margin_gap_pp"),
            F.col("p.migration_pair").alias("worst_migration_pair"),
            F.col("p.llm_cost_per_credit_usd").alias("worst_pair_cost_per_credit_usd"),
            F.col("t.task_type").alias("worst_task"),
            F.col("t.margin_per_credit_usd").alias("worst_task_margin_per_credit_usd"),
        )
    )


def headline_channels(channels: DataFrame) -> DataFrame:
    """M03 from R05: best and worst channel by self-serve conversion, undefined rates left out."""
    rate = "self_serve_conversion_pct"
    fields = ["acquisition_channel", rate]
    return (
        channels.where(F.col(rate).isNotNull())
        .agg(
            _best(F.struct(F.col(rate), F.col("acquisition_channel")), fields).alias("b"),
            _best(F.struct(F.col(rate), F.col("acquisition_channel")), fields, False).alias("w"),
        )
        .select(
            F.col("b.acquisition_channel").alias("best_channel"),
            F.col(f"b.{rate}").alias("best_conversion_pct"),
            F.col("w.acquisition_channel").alias("worst_channel"),
            F.col(f"w.{rate}").alias("worst_conversion_pct"),
        )
    )


def activation_lift(thresholds: DataFrame) -> DataFrame:
    """M04 from C02: conversion at five of five successes minus conversion of all, in points."""

    def at(k: int) -> Column:
        return F.max(F.when(F.col("min_successes_of_5") == k, F.col("self_serve_conversion_rate")))

    return thresholds.agg(((at(5) - at(0)) * 100).alias("activation_lift_pp"))


def strongest_driver(odds: DataFrame, level: float = 0.05) -> DataFrame:
    """M05 from C05: largest |ln OR| among significant features, among all if none is."""
    return (
        odds.where(F.col("odds_ratio").isNotNull())
        .agg(
            _best(
                F.struct((F.col("p_value") < level).alias("s"), F.abs(F.ln("odds_ratio")).alias("m"), "feature"),
                ["feature", "odds_ratio", "p_value"],
            ).alias("d")
        )
        .select("d.*", format_p("d.p_value").alias("p_label"))
    )


def headline_costs(savings: DataFrame, failures: DataFrame, matrix: DataFrame) -> DataFrame:
    """M06 from L08, R12 and R06: routing savings, reliability cost, failed share and worst combination."""
    impact = F.col("annual_dollar_impact_usd")
    routed = savings.agg(
        F.coalesce(F.sum(F.when(F.col("routing_action") == "route_to_cheaper_model", impact)), F.lit(0.0)).alias(
            "annual_routing_savings_usd"
        ),
        F.coalesce(-F.sum(F.when(F.col("routing_action") == "invest_in_reliability", impact)), F.lit(0.0)).alias(
            "annual_reliability_cost_usd"
        ),
    )
    failed = failures.agg(
        F.sum("failed_llm_cost_usd").alias("failed"),
        _best(
            F.struct("failed_llm_cost_usd", "model", "task_type"), ["model", "task_type", "failed_llm_cost_usd"]
        ).alias("top"),
    )
    spend = scalar(matrix.agg(F.sum("total_llm_cost_usd").alias("s")), "s")
    return (
        routed.withColumn("f", scalar(failed.select(F.struct("failed", "top").alias("f")), "f"))
        .withColumn("_spend", spend)
        .select(
            "annual_routing_savings_usd",
            "annual_reliability_cost_usd",
            F.col("f.failed").alias("failed_llm_cost_usd"),
            (ratio(F.col("f.failed"), "_spend") * 100).alias("failed_share_pct"),
            F.col("f.top.model").alias("top_failure_model"),
            F.col("f.top.task_type").alias("top_failure_task"),
            F.col("f.top.failed_llm_cost_usd").alias("top_failure_cost_usd"),
        )
    )


def scenario_best(scenarios: DataFrame) -> DataFrame:
    """M07 from P10: the scenario with the best margin against the status quo."""
    status_quo = F.max(F.when(F.col("scenario") == "status_quo", F.col("gross_margin_pct")))
    return (
        scenarios.agg(
            _best(F.struct("gross_margin_pct", "scenario"), ["scenario", "gross_margin_pct"]).alias("b"),
            status_quo.alias("status_quo_margin_pct"),
        )
        .select(
            F.col("b.scenario").alias("best_scenario"),
            F.col("b.gross_margin_pct").alias("best_margin_pct"),
            "status_quo_margin_pct",
        )
        .withColumn("gain_pp", F.col("best_margin_pct") - F.col("status_quo_margin_pct"))
    )


def retention_cells(retention: DataFrame, value: str = "retention_pct") -> DataFrame:
    """M08 from R03 or D05 in long form: every cohort with every month since signup that occurs, NULL where it has none yet."""
    return dense(retention.select("cohort_month", "months_since_signup", value), "cohort_month", "months_since_signup")


def retention_matrix(retention: DataFrame, value: str = "retention_pct") -> DataFrame:
    """M08 from R03 or D05: cohort by months since signup, a column m0, m1, ... for every month that occurs."""
    month = F.concat(F.lit("m"), F.col("months_since_signup").cast("string"))
    return retention.withColumn("column", month).groupBy("cohort_month").pivot("column").agg(F.max(value))


def month_n_average(retention: DataFrame, month: int, value: str = "retention_pct") -> DataFrame:
    """Mean retention over cohorts in one month since signup."""
    return retention.where(F.col("months_since_signup") == month).agg(
        F.lit(month).alias("months_since_signup"), F.avg(value).alias("mean_retention"), F.count(value).alias("cohorts")
    )


def model_task_cells(matrix: DataFrame, value: str = "success_pct") -> DataFrame:
    """M09 from R06 in long form: every task with every model, and the task's spread between models."""
    of_task = W.partitionBy("task_type")
    spread = (F.max(value).over(of_task) - F.min(value).over(of_task)).alias("spread_pp")
    cells = dense(matrix.select("task_type", "model", value), "task_type", "model").select("task_type", "model", value, spread)
    return cells.withColumn("is_widest", F.col("spread_pp") == F.max("spread_pp").over(W.partitionBy()))


def model_task_wide(matrix: DataFrame, value: str = "success_pct") -> DataFrame:
    """M09 from R06: one row per task, one column for every model that occurs, and the spread between them."""
    wide = matrix.groupBy("task_type").pivot("model").agg(F.max(value))
    spread = matrix.groupBy("task_type").agg((F.max(value) - F.min(value)).alias("spread_pp"))
    widest = F.max("spread_pp").over(W.partitionBy())
    return wide.join(spread.withColumn("is_widest", F.col("spread_pp") == widest), "task_type")


def km_steps(curve: DataFrame) -> DataFrame:
    """M10 from C09: each curve with its starting point (0, 1)."""
    start = curve.select("group").distinct().select("group", F.lit(0).cast("long").alias("t"), F.lit(1.0).alias("survival"))
    return start.unionByName(curve.select("group", F.col("t").cast("long").alias("t"), "survival"))


def km_gap(curve: DataFrame, t: int = 6) -> DataFrame:
    """Survival gap between the two curves at t; NULL unless both have that point."""
    at = curve.where(F.col("t") == t).agg(
        F.count(F.lit(1)).alias("k"), F.max("survival").alias("hi"), F.min("survival").alias("lo")
    )
    return at.select(F.lit(t).alias("t"), F.when(F.col("k") == 2, (F.col("hi") - F.col("lo")) * 100).alias("gap_pp"))


PERSONA_CHART_FEATURES = ["avg_monthly_runs", "failure_rate", "migration_share", "activation_score", "avg_llm_cost"]


def persona_minmax(profile: DataFrame, features: Sequence[str] = PERSONA_CHART_FEATURES) -> DataFrame:
    """M11 from C15: features scaled to 0..1 across personas, 0.5 when they do not vary."""
    everything = W.partitionBy()

    def scaled(column: str) -> Column:
        low, high = F.min(column).over(everything), F.max(column).over(everything)
        return F.coalesce(F.try_divide(F.col(column) - low, high - low), F.lit(0.5)).alias(column)

    return profile.select("persona_name", *[scaled(c) for c in features])


def arm_wald_ci(frame: DataFrame) -> DataFrame:
    """Conversion rate and half-width of its Wald interval per arm, in percent."""
    counts = arm_counts(frame)
    rows = F.explode(
        F.array(
            F.struct(F.lit("control").alias("variant"), F.col("n1").alias("n"), F.col("x1").alias("x")),
            F.struct(F.lit("treatment").alias("variant"), F.col("n2").alias("n"), F.col("x2").alias("x")),
        )
    )
    p = ratio("x", "n")
    return counts.select(rows.alias("a")).select("a.*").select(
        "variant",
        "n",
        (p * 100).alias("conversion_pct"),
        (F.sqrt(F.try_divide(p * (1 - p), dbl("n"))) * 100 * 1.96).alias("half_width_pp"),
    )


def outcome_by_activation(customers_activation: DataFrame) -> DataFrame:
    """M13 from D06: conversion and retention of activated and other customers."""
    n = F.count(F.lit(1))
    return customers_activation.groupBy("activated").agg(
        ratio(F.count_if("self_serve_converted"), n).alias("conversion_rate"),
        ratio(F.count_if("retained"), n).alias("retention_rate"),
        n.alias("n"),
    )


def labelled_p_values(tests: DataFrame) -> DataFrame:
    """P-values with their display label."""
    return tests.withColumn("p_label", format_p("p_value"))
