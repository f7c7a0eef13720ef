"""Model quality and cost: pooled against stratified rates, frontier, routing, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import dbl, month_of, ratio, succeeded
from usagelens.functions.draws import binomial_interval
from usagelens.functions.stats import chi_square_statistic, chi_square_tail, student_t_two_sided
from usagelens.operators.usage import average_cost, success_rate

ROUTING_TOLERANCE = 0.02
BOOTSTRAP_REPLICATES = 2000


def pooled_success(runs: DataFrame) -> DataFrame:
    """Success rate per model over all tasks."""
    return runs.groupBy("model").agg(success_rate().alias("pooled_success_rate"))


def stratified_success(runs: DataFrame) -> DataFrame:
    """Success rate per task and model."""
    return runs.groupBy("task_type", "model").agg(
        success_rate().alias("success_rate"), F.count(F.lit(1)).alias("n_runs")
    )


def simpsons_reversal(runs: DataFrame) -> DataFrame:
    """Per model pair, the share of common tasks whose winner is also the pooled winner.

    Runs are scanned once: the pooled rates are sums over the (task, model) counts. The
    pairs, which are the result rows, are formed on that table of at most tasks x models rows.
    """
    counts = runs.groupBy("task_type", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(succeeded()).alias("ok")
    )
    by_model = W.partitionBy("model")
    rated = counts.select(
        "task_type",
        "model",
        ratio("ok", "n").alias("rate"),
        ratio(F.sum("ok").over(by_model), F.sum("n").over(by_model)).alias("pooled"),
    )
    everyone = F.collect_set(F.struct("model", "pooled")).over(W.partitionBy())
    others = rated.withColumn("everyone", everyone).withColumn("other", F.explode("everyone"))
    # the better pooled model comes first; equal pooled rates are ordered by name
    first = (F.col("pooled") > F.col("other.pooled")) | (
        (F.col("pooled") == F.col("other.pooled")) & (F.col("model") < F.col("other.model"))
    )
    second = rated.select("task_type", F.col("model").alias("model_b"), F.col("rate").alias("rate_b"))
    pairs = (
        others.where(first)
        .select(
            "task_type",
            F.col("model").alias("model_a"),
            F.col("other.model").alias("model_b"),
            "rate",
            (F.col("pooled") > F.col("other.pooled")).alias("a_leads"),
        )
        .join(second, ["task_type", "model_b"], "left")
    )
    agrees = (F.col("rate") > F.col("rate_b")) == F.col("a_leads")
    return (
        pairs.groupBy("model_a", "model_b")
        .agg(
            F.when(F.max("a_leads"), F.max("model_a")).otherwise(F.max("model_b")).alias("pooled_winner"),
            ratio(F.count_if(agrees), F.count("rate_b")).alias("pct_task_strata_agreeing_with_pooled_winner"),
        )
        .withColumn(
            "reversal_flag",
            F.coalesce(F.col("pct_task_strata_agreeing_with_pooled_winner") == 0, F.lit(False)),
        )
    )


def chi_square(frame: DataFrame, row: str = "model", column: str = "status") -> DataFrame:
    """Pearson independence test with Cramer's V."""
    tested = chi_square_statistic(frame, row, column)
    return tested.withColumn("p_value", chi_square_tail(F.col("chi2_statistic"), dbl("degrees_of_freedom")))


def cost_quality_frontier(runs: DataFrame) -> DataFrame:
    """Points (cost, success) per task and model that no other model dominates.

    A point is dominated when some model at most as expensive succeeds strictly more often, or
    some model succeeding at least as often is strictly cheaper: two window extremes per task.
    """
    points = runs.groupBy("task_type", "model").agg(
        average_cost().alias("avg_cost_usd"),
        success_rate().alias("success_rate"),
        F.count(F.lit(1)).alias("n_runs"),
    )
    cheaper = W.partitionBy("task_type").orderBy("avg_cost_usd").rangeBetween(W.unboundedPreceding, W.currentRow)
    better = W.partitionBy("task_type").orderBy(F.desc("success_rate")).rangeBetween(
        W.unboundedPreceding, W.currentRow
    )
    dominated = (F.max("success_rate").over(cheaper) > F.col("success_rate")) | (
        F.min("avg_cost_usd").over(better) < F.col("avg_cost_usd")
    )
    return points.withColumn("on_pareto_frontier", ~dominated)


def bootstrap_rate_ci(runs: DataFrame, groups: list[str], replicates: int = BOOTSTRAP_REPLICATES) -> DataFrame:
    """Bootstrap interval of the success rate per group. The sum of a resample of 0/1 labels is binomial, so each
    group is one row of counts; a group with a NULL label is compared by its text."""
    counts = runs.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(succeeded()).alias("n_success"))
    return _with_interval(counts, groups, replicates).select(
        *groups,
        "n_runs",
        "n_success",
        ratio("n_success", "n_runs").alias("success_rate"),
        F.col("ci_low").alias("success_rate_ci_low"),
        F.col("ci_high").alias("success_rate_ci_high"),
    )


def _with_interval(counts: DataFrame, groups: list[str], replicates: int) -> DataFrame:
    interval = binomial_interval(counts, groups, "n_runs", "n_success", replicates)
    interval = interval.select(*[F.col(g).alias(f"_{g}") for g in groups], "ci_low", "ci_high")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return counts.join(interval, same, "left").drop(*[f"_{g}" for g in groups])


def routing_rates(runs: DataFrame, tolerance: float = ROUTING_TOLERANCE) -> DataFrame:
    """L07 without intervals: best model and cheapest model within ``tolerance`` of it, per task."""
    per_task = W.partitionBy("task_type")
    rated = runs.groupBy("task_type", "model").agg(
        success_rate().alias("success_rate"),
        average_cost().alias("avg_cost_usd"),
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(succeeded()).alias("n_success"),
    )
    eligible = F.col("success_rate") >= F.col("_best") - tolerance
    choice = F.min(F.when(eligible, F.struct("avg_cost_usd", "model"))).over(per_task)
    leader = F.min(F.struct((-F.col("success_rate")).alias("r"), "model")).over(per_task)
    return (
        rated.withColumn("_best", F.max("success_rate").over(per_task))
        .withColumn("_choice", choice["model"])
        .withColumn("_leader", leader["model"])
        .withColumn("is_current_best_success", F.col("model") == F.col("_leader"))
        .withColumn("is_recommended", F.col("model") == F.col("_choice"))
        .drop("_best", "_choice", "_leader")
    )


def routing_policy(
    runs: DataFrame, tolerance: float = ROUTING_TOLERANCE, replicates: int = BOOTSTRAP_REPLICATES
) -> DataFrame:
    """Routing recommendation with bootstrap intervals on every candidate."""
    return _with_interval(routing_rates(runs, tolerance), ["task_type", "model"], replicates).select(
        "task_type",
        "model",
        "success_rate",
        F.col("ci_low").alias("success_rate_ci_low"),
        F.col("ci_high").alias("success_rate_ci_high"),
        "avg_cost_usd",
        "n_runs",
        "is_current_best_success",
        "is_recommended",
    )


def routing_savings(runs: DataFrame, tolerance: float = ROUTING_TOLERANCE) -> DataFrame:
    """Current mix against the recommended model per task, scaled to month and year.

    One aggregate per (task, model, month) feeds everything: the current mix is its sum per
    task, the candidates its sum per model, the observed months its distinct months.
    """
    per_task = W.partitionBy("task_type")
    monthly = runs.groupBy("task_type", "model", month_of("started_at").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(succeeded()).alias("ok"), F.sum("llm_cost_usd").alias("cost")
    )
    counts = (
        monthly.withColumn("months", F.size(F.collect_set("month").over(W.partitionBy())))
        .groupBy("task_type", "model")
        .agg(*[F.sum(c).alias(c) for c in ("n", "ok", "cost")], F.max("months").alias("months"))
    )
    rated = (
        counts.withColumn("rate", ratio("ok", "n"))
        .withColumn("avg_cost", ratio("cost", "n"))
        .withColumn("best", F.max("rate").over(per_task))
    )
    eligible = F.col("rate") >= F.col("best") - tolerance
    tasks = (
        rated.groupBy("task_type")
        .agg(
            ratio(F.sum("cost"), F.sum("n")).alias("current_avg_cost_usd"),
            ratio(F.sum("ok"), F.sum("n")).alias("current_success_rate"),
            F.sum("n").alias("n_runs"),
            F.max("months").alias("months"),
            F.min(F.when(eligible, F.struct("avg_cost", "model", "rate"))).alias("c"),
        )
        .withColumn("recommended_model", F.col("c.model"))
        .withColumn("recommended_success_rate", F.col("c.rate"))
        .withColumn("recommended_avg_cost_usd", F.col("c.avg_cost"))
        .drop("c")
    )
    delta = F.col("cost_delta_per_run_usd")
    return (
        tasks.withColumn("cost_delta_per_run_usd", F.col("current_avg_cost_usd") - F.col("recommended_avg_cost_usd"))
        .withColumn(
            "routing_action", F.when(delta > 0, "route_to_cheaper_model").otherwise("invest_in_reliability")
        )
        .withColumn(
            "success_rate_delta_pp", (F.col("recommended_success_rate") - F.col("current_success_rate")) * 100
        )
        .withColumn("runs_per_month", ratio("n_runs", "months"))
        .withColumn("monthly_dollar_impact_usd", delta * F.col("runs_per_month"))
        .withColumn("annual_dollar_impact_usd", F.col("monthly_dollar_impact_usd") * 12)
        .drop("months")
    )


def _ordinal(status: str = "status") -> Column:
    return F.when(F.col(status) == "failed", 0).when(F.col(status) == "partial", 1).when(F.col(status) == "success", 2)


def rating_status_spearman(runs: DataFrame) -> DataFrame:
    """Rank correlation of outcome and human rating on rated runs, from at most 3 x 5 counts."""
    everything = W.partitionBy()
    cells = (
        runs.where(F.col("human_rating").isNotNull())
        .groupBy(_ordinal().alias("s"), F.col("human_rating").alias("r"))
        .agg(F.count(F.lit(1)).alias("c"))
        .where(F.col("s").isNotNull())
    )

    def mid_rank(column: str) -> Column:
        # rank of a tie block = rows before it + (rows in it + 1) / 2
        upto = F.sum("c").over(W.orderBy(column).rangeBetween(W.unboundedPreceding, W.currentRow))
        block = F.sum("c").over(W.partitionBy(column))
        return dbl(upto) - (dbl(block) - 1) / 2

    ranked = cells.select(
        dbl("c").alias("c"),
        mid_rank("s").alias("x"),
        mid_rank("r").alias("y"),
        "s",
        dbl("r").alias("r"),
    ).withColumn("n", F.sum("c").over(everything))
    centre = (F.col("n") + 1) / 2
    dx, dy, c = F.col("x") - centre, F.col("y") - centre, F.col("c")

    def mean_rating(level: int) -> Column:
        here = F.col("s") == level
        return F.try_divide(F.sum(F.when(here, c * F.col("r"))), F.sum(F.when(here, c)))

    summed = ranked.agg(
        F.sum("c").cast("long").alias("n_rated_runs"),
        F.try_divide(F.sum(c * dx * dy), F.sqrt(F.sum(c * dx * dx) * F.sum(c * dy * dy))).alias("spearman_rho"),
        mean_rating(0).alias("mean_rating_failed"),
        mean_rating(1).alias("mean_rating_partial"),
        mean_rating(2).alias("mean_rating_success"),
    )
    rho, dof = F.col("spearman_rho"), dbl(F.col("n_rated_runs") - 2)
    t = rho * F.sqrt(F.try_divide(dof, (1 - rho) * (1 + rho)))
    return summed.withColumn("p_value", F.when(F.abs(rho) == 1, 0.0).otherwise(student_t_two_sided(t, dof)))
