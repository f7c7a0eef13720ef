"""Registry of every query: name -> callable(tables) over the domain tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions import stats
from usagelens.functions.columns import flag, months_between_starts, scalar
from usagelens.functions.ranking import ensure_checkpoint_dir
from usagelens.operators import (
    attempts,
    customers,
    filtered,
    headline,
    models,
    pricing,
    quality,
    reports,
    star,
    usage,
    whatif,
)
from usagelens.plans.mapping import EXPERIMENT_END, EXPERIMENT_NAME, EXPERIMENT_START, KeptTables, StarTables, Tables
from usagelens.schemas import ATTEMPTS as ATTEMPTS_SCHEMA
from usagelens.schemas import TABLES
from usagelens.sources import sinks, tables

Query = Callable[[Tables], DataFrame]

REPORTS: dict[str, Query] = {
    "r01_monthly_kpis": lambda t: reports.monthly_kpis(t.customer_months, t.customers),
    "r02_nrr_grr": lambda t: reports.nrr_grr(t.customer_months),
    "r03_cohort_retention": lambda t: reports.cohort_retention(t.customer_months, t.customers),
    "r04_activation": lambda t: reports.activation(t.runs, t.customers, t.customer_months),
    "r05_channel_performance": lambda t: reports.channel_performance(t.customers, t.customer_months),
    "r06_model_task_matrix": lambda t: reports.model_task_matrix(t.runs),
    "r07_migration_pairs": lambda t: reports.migration_pairs(t.runs),
    "r08_unit_economics_plan": lambda t: reports.unit_economics_plan(t.customer_months, t.runs),
    "r09_task_cost_per_credit": lambda t: reports.task_cost_per_credit(t.runs, t.customer_months),
    "r10_customer_margin_deciles": lambda t: reports.customer_margin_deciles(t.customer_months, t.runs, t.customers),
    "r11_experiment_results": lambda t: reports.experiment_results(
        t.experiment_assignments, t.customers, t.customer_months, EXPERIMENT_NAME
    ),
    "r12_failure_cost": lambda t: reports.failure_cost(t.runs),
}


def plain(frame: DataFrame) -> DataFrame:
    """Report form of a frame: dates and times as ISO text, decimals as doubles."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampType | T.TimestampNTZType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def _features(t: Tables) -> DataFrame:
    return customers.customer_usage_features(t.customers, t.runs, t.customer_months)


def _panel(t: Tables) -> DataFrame:
    return customers.survival_panel(t.customer_months, t.customers, t.runs)


def _tenure_subjects(t: Tables) -> DataFrame:
    """Months from signup to churn or to the end of the data, by channel."""
    latest = scalar(t.customer_months.agg(F.max("month").alias("m")), "m")
    end = F.coalesce(F.trunc("churn_date", "month"), latest)
    return t.customers.select(
        "acquisition_channel",
        flag(F.col("status") == "churned").alias("event"),
        (months_between_starts(end, F.trunc("signup_date", "month")) + 1).alias("duration"),
    )


CUSTOMERS: dict[str, Query] = {
    "c01_activation_scores": lambda t: usage.activation_scores(t.runs),
    "c02_activation_threshold": lambda t: customers.activation_threshold(t.runs, t.customers, t.customer_months),
    "c03_lagged_monthly_run_stats": lambda t: customers.lagged_monthly_run_stats(t.runs),
    "c04_survival_panel": _panel,
    "c05_hazard_odds_ratios": lambda t: customers.hazard_odds_ratios(_panel(t)),
    "c06_hazard_holdout_auc": lambda t: t.spark.createDataFrame(
        [(customers.hazard_holdout_auc(_panel(t)),)], "holdout_roc_auc double"
    ),
    "c07_churn_model_summary": lambda t: customers.churn_model_summary(_panel(t)),
    "c08_kaplan_meier": lambda t: stats.kaplan_meier(_tenure_subjects(t), "duration", "event", "acquisition_channel"),
    "c09_km_by_activation": lambda t: customers.km_by_activation(_panel(t), t.customer_months),
    "c10_customer_usage_features": _features,
    "c11_never_paid_segment": lambda t: customers.never_paid_segment(_features(t)),
    "c12_cluster_matrix": lambda t: customers.cluster_matrix(_features(t).where("ever_paid")),
    "c13_choose_k": lambda t: customers.persona_k_selection(_features(t)),
    "c14_personas": lambda t: customers.personas(_features(t))[0],
    "c15_name_personas": lambda t: customers.personas(_features(t))[1],
}


def _experiment(t: Tables) -> DataFrame:
    return pricing.experiment_frame(t.experiment_assignments, t.customers, t.customer_months, EXPERIMENT_NAME)


MODELS: dict[str, Query] = {
    "l01_pooled_success": lambda t: models.pooled_success(t.runs),
    "l02_stratified_success": lambda t: models.stratified_success(t.runs),
    "l03_simpsons_reversal": lambda t: models.simpsons_reversal(t.runs),
    "l04_chi_square": lambda t: models.chi_square(t.runs),
    "l05_cost_quality_frontier": lambda t: models.cost_quality_frontier(t.runs),
    "l06_bootstrap_rate_ci": lambda t: models.bootstrap_rate_ci(t.runs, ["task_type", "model"]),
    "l07_routing_rates": lambda t: models.routing_rates(t.runs),
    "l07_routing_policy": lambda t: models.routing_policy(t.runs),
    "l08_routing_savings": lambda t: models.routing_savings(t.runs),
    "l09_rating_status_spearman": lambda t: models.rating_status_spearman(t.runs),
}

PRICING: dict[str, Query] = {
    "p01_margin_by_plan": lambda t: pricing.margin_by_plan(t.customer_months, t.runs),
    "p02_margin_by_task": lambda t: pricing.margin_by_task(t.runs, t.customer_months),
    "p03_margin_by_decile": lambda t: pricing.margin_by_decile(t.customer_months, t.runs),
    "p04_experiment_frame": _experiment,
    "p05_two_proportion_z": lambda t: pricing.two_proportion_z(_experiment(t)),
    "p06_bootstrap_revenue_ci": lambda t: pricing.bootstrap_revenue_ci(_experiment(t)),
    "p07_power_and_mde": lambda t: pricing.power_and_mde(_experiment(t)),
    "p08_effect_size_to_p2": lambda t: pricing.recovered_rate(_experiment(t)),
    "p09_arc_elasticity": lambda t: pricing.arc_elasticity(_experiment(t)),
    "p10_pricing_scenarios": lambda t: pricing.pricing_scenarios(t.customer_months, t.runs),
}

FILTERABLE: dict[str, Callable[[Tables, filtered.Filters], DataFrame]] = {
    "d02_monthly_financials": lambda t, f: filtered.monthly_financials(t.customer_months, t.runs, t.customers, f),
    "d03_run_success_rate": lambda t, f: filtered.run_success_rate(t.agent_runs, t.customers, f),
    "d04_nrr_average": lambda t, f: filtered.nrr_average(t.customer_months, t.customers, f),
    "d05_cohort_retention_any": lambda t, f: filtered.cohort_retention_any(t.customer_months, t.customers, f),
    "d06_activation_by_customer": lambda t, f: filtered.activation_by_customer(t.runs, t.customers, f),
    "d07_channel_summary": lambda t, f: filtered.channel_summary(t.runs, t.customers, f),
    "d08_model_task_success": lambda t, f: filtered.model_task_success(t.runs, t.customers, f),
    "d09_cost_per_success": lambda t, f: filtered.cost_per_success(t.runs, t.customers, f),
    "d10_migration_pairs_filtered": lambda t, f: filtered.migration_pairs(t.runs, t.customers, f),
    "d11_executive_kpis": lambda t, f: filtered.executive_kpis(t.customer_months, t.runs, t.customers, f),
    "d12_failure_tax": lambda t, f: filtered.failure_tax(t.runs, t.customers, f),
    "d13_margin_by_plan_filtered": lambda t, f: filtered.margin_by_plan(t.customer_months, t.runs, t.customers, f),
    "d14_cost_per_credit_by_task": lambda t, f: filtered.cost_per_credit_by_task(t.runs, t.customer_months, t.customers, f),
    "d14_team_revenue_per_credit": lambda t, f: filtered.team_revenue_per_credit(t.customer_months, t.customers, f),
    "d15_margin_deciles_filtered": lambda t, f: filtered.margin_deciles(t.customer_months, t.runs, t.customers, f),
    "d15_margin_decile_summary": lambda t, f: filtered.margin_decile_summary(
        filtered.margin_deciles(t.customer_months, t.runs, t.customers, f)
    ),
    "d18_simple_task_frontier_stats": lambda t, f: filtered.simple_task_frontier_stats(t.runs, t.customers, f),
    "d19_routing_what_if": lambda t, f: filtered.routing_what_if(t.runs, t.customers, f),
}

#: What the filtered variants select; ``d11`` has no plans, because its parts honour them differently.
CHOSEN = filtered.Filters(
    months=("2025-03-01", "2025-04-01", "2025-06-01"), plans=("Pro", "Team"), regions=("EUROPE", "ASIA"),
    channels=("Organic", "Referral"), industries=("BUILDING", "MACHINERY", "FURNITURE"),
)


def _all_invalid(t: Tables) -> DataFrame:
    options = tables.filter_options(_domain(t))
    nothing = filtered.Filters.build(options, regions=["Atlantis"], months=["1999-01-01"], plans=["Gold"], channels=[""], industries=["x"])
    return FILTERABLE["d02_monthly_financials"](t, nothing)


def _with_filters(name: str, chosen: filtered.Filters) -> Query:
    return lambda t: FILTERABLE[name](t, chosen)


FILTERED: dict[str, Query] = {
    **{name: _with_filters(name, filtered.Filters()) for name in FILTERABLE},
    **{
        f"{name.removesuffix('_filtered')}_selected": _with_filters(name, replace(CHOSEN, plans=()) if name.startswith("d11") else CHOSEN)
        for name in FILTERABLE
    },
    "d01_all_invalid_selection": _all_invalid,
    "d16_experiment_conversion": lambda t: filtered.experiment_conversion(
        t.experiment_assignments, t.customers, EXPERIMENT_NAME
    ),
    "d17_experiment_readout": lambda t: filtered.experiment_readout(
        t.experiment_assignments, t.customers, EXPERIMENT_NAME
    ),
}


def _baseline(t: Tables) -> DataFrame:
    return whatif.simulator_baseline(
        t.plans, t.customers, t.customer_months, t.runs, t.experiment_assignments, EXPERIMENT_NAME
    )


WHAT_IF: dict[str, Query] = {
    "x01_workbook_monthly_kpis": lambda t: whatif.workbook_monthly_kpis(t.customer_months, t.runs),
    "x02_workbook_plan_economics": lambda t: whatif.workbook_plan_economics(t.customer_months, t.runs),
    "x03_workbook_model_task": lambda t: whatif.workbook_model_task(t.runs),
    "x04_customer_summary": lambda t: whatif.customer_summary(t.customers, t.customer_months, t.runs),
    "x05_customer_month_flat": lambda t: whatif.customer_month_flat(t.customer_months, t.runs, t.customers),
    "x06_simulator_baseline": _baseline,
    "x06_simulator_task_mix": lambda t: whatif.simulator_task_mix(t.plans, t.customer_months, t.runs),
    "x07_pricing_what_if": lambda t: whatif.pricing_what_if(_baseline(t), {"Pro": 35.0}, 0.3, 0.02),
    "x08_scenario_grid": lambda t: whatif.scenario_grid(_baseline(t)),
}


def _star(t: Tables) -> dict[str, DataFrame]:
    return star.star_schema(t.customers, t.plans, t.models, t.customer_months, t.agent_runs, t.keyed_runs)


def _fact_runs(t: Tables) -> DataFrame:
    customer_dim = star.dim_customer(t.customers)
    return star.fact_agent_runs(
        t.keyed_runs(customer_dim), customer_dim, star.dim_plan(t.plans), star.dim_model(t.models), star.dim_task(t.runs)
    )


def _monthly_measures(t: Tables) -> DataFrame:
    customer_dim, plan_dim = star.dim_customer(t.customers), star.dim_plan(t.plans)
    facts = star.fact_customer_month(t.customer_months, t.runs, customer_dim, plan_dim)
    return star.star_monthly_measures(facts, plan_dim, customer_dim)


def _plan_usage(t: Tables) -> DataFrame:
    """The plan dimension with the billing rows that point at each plan."""
    used = t.customer_months.groupBy("plan").agg(F.count(F.lit(1)).alias("customer_months"))
    return star.dim_plan(t.plans).join(used, "plan", "left")


def _model_usage(t: Tables) -> DataFrame:
    """The model dimension with the runs that point at each model."""
    used = t.runs.groupBy("model").agg(F.count(F.lit(1)).alias("n_runs"))
    return star.dim_model(t.models).join(used, "model", "left")


STAR: dict[str, Query] = {
    "s01_dim_customer": lambda t: star.dim_customer(t.customers),
    "s02_dim_plan_usage": _plan_usage,
    "s03_dim_model_usage": _model_usage,
    "s04_dim_task": lambda t: star.dim_task(t.runs),
    "s05_dim_date": lambda t: star.dim_date(t.runs, t.customer_months, t.customers),
    "s06_fact_agent_runs": _fact_runs,
    "s07_fact_customer_month": lambda t: star.fact_customer_month(
        t.customer_months, t.runs, star.dim_customer(t.customers), star.dim_plan(t.plans)
    ),
    "s08_star_monthly_measures": _monthly_measures,
    "s08_star_run_measures": lambda t: star.star_run_measures(_fact_runs(t)),
}


def _price_table(t: Tables) -> DataFrame:
    """Listed models plus the default row; the hosted model is unlisted and takes the default price."""
    hosted = F.when(F.col("model") == "open-weights-hosted", "_default").otherwise(F.col("model"))
    return t.models.withColumn("model", hosted)


# What stands before and after a response's text, by the text's length modulo 5.
_WRAPS = [
    ("Here it is:\n```python\n", "\n```\nDone."),
    ("```\n", "\n```\nand\n```py\ndef f():\n    return 1\n```"),
    ("```python3\n", ""),
    ("Sure.\n  import os\n", ""),
    ("", ""),
]


def _wrapped_responses(t: Tables) -> DataFrame:
    """The responses as a model may send code: in a fence, with a later function, in an open fence, without one, as they are."""
    part = F.pmod(F.length("text"), F.lit(len(_WRAPS)))
    text = F
    for i, (before, after) in enumerate(_WRAPS):
        text = text.when(part == i, F.concat(F.lit(before), "text", F.lit(after)))
    return t.responses.withColumn("text", text)


ATTEMPTS: dict[str, Query] = {
    "b01_wilson_ci": lambda t: attempts.wilson_ci(t.attempts, ["model", "task_id"]),
    "b02_pass_at_k": lambda t: attempts.pass_at_k(t.attempts, ["model"], 3),
    "b03_benchmark_by_model": lambda t: attempts.by_model(t.attempts),
    "b04_benchmark_by_model_task_type": lambda t: attempts.by_model_task_type(t.attempts),
    "b05_contingency": lambda t: attempts.contingency_counts(t.attempts),
    "b05_outcome_chi2": lambda t: attempts.outcome_test(t.attempts),
    "b06_test_pass_fraction": lambda t: attempts.passed_test_fraction(t.attempts),
    "b07_error_breakdown": lambda t: attempts.error_breakdown(t.attempts),
    "b08_benchmark_header": lambda t: attempts.header(t.attempts),
    "b09_price_attempts": lambda t: attempts.price_attempts(t.attempts, _price_table(t))
    .groupBy("model", "task_type")
    .agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("n_attempts")),
    "b10_extract_code": lambda t: attempts.extract_code(t.responses),
    "b10_extract_code_fenced": lambda t: attempts.extract_code(_wrapped_responses(t)),
    "b11_grade_status": lambda t: attempts.graded(t.attempts),
}

def _spoil(frame: DataFrame, key: Column, faults: dict[str, dict[int, object]]) -> DataFrame:
    """A copy with faults: per column, the value of rows whose key is divisible by a number (the first that fits)."""
    spoiled = {}
    for name, cases in faults.items():
        value = F
        for divisor, wrong in cases.items():
            value = value.when(key % divisor == 0, wrong)
        spoiled[name] = value.otherwise(F.col(name))
    return frame.withColumns(spoiled)


def _quality(t: Tables, soiled: bool) -> DataFrame:
    runs, months, assigned = t.runs, t.customer_months, t.experiment_assignments
    if soiled:
        number = F.right("customer_id", F.lit(8)).cast("long")
        runs = _spoil(
            runs, F.col("input_tokens"),
            {
                "llm_cost_usd": {97: -F.col("llm_cost_usd") - 1, 101: None},
                "tests_passed": {103: F.col("tests_total") + 1, 107: None},
                "human_rating": {109: 6},
                "status": {113: "lost", 127: None},
                "started_at": {131: F.lit("2000-01-01").cast("timestamp_ntz"), 137: F.lit("2100-01-01").cast("timestamp_ntz"), 139: None},
                "customer_id": {149: "nobody"},
                "run_id": {151: "twice"},
            },
        )
        months = _spoil(
            months, number,
            {
                "credits_used": {97: -1, 101: None},
                "revenue_usd": {103: F.col("revenue_usd") + 1, 107: None},
                "plan": {109: "Free", 113: None},
                "month": {127: F.lit("2025-01-01").cast("date")},
            },
        )
        led = F.concat(F.lit("C"), F.lpad((F.floor(number / 10) * 10).cast("string"), 8, "0"))
        assigned = _spoil(
            assigned, number,
            {"assigned_at": {7: F.lit("2025-05-01").cast("date"), 11: None}, "pro_price_shown": {13: 30, 17: None}, "customer_id": {19: led}},
        )
    return quality.quality_report(
        t.customers, runs, months, assigned, (EXPERIMENT_START, EXPERIMENT_END), {"control": 29, "treatment": 39}
    )


QUALITY: dict[str, Query] = {
    "q01_q18_quality_report": lambda t: _quality(t, soiled=False),
    "q01_q18_soiled_quality_report": lambda t: _quality(t, soiled=True),
    "q19_star_quality": lambda t: quality.star_quality(
        _star(t),
        {
            "dim_customer": t.customers,
            "fact_agent_runs": t.runs,
            "fact_customer_month": t.customer_months,
        },
    ),
    "q20_dataset_summary": lambda t: quality.dataset_summary(
        t.customers, t.runs, t.customer_months, t.experiment_assignments
    ),
}

# Columns of the runs that R06, R12 and L08 use, and those that R01 to R12 use.
_COST_COLUMNS = (
    "task_type", "model", "status", "started_at", "steps", "latency_sec", "input_tokens", "output_tokens", "llm_cost_usd",
)
_REPORT_COLUMNS = (*_COST_COLUMNS, "run_id", "customer_id", "source_stack", "target_stack", "credits_charged")


def _headline_costs(t: Tables) -> DataFrame:
    """The three reports read the same runs: lines and orders are joined once, not once a report."""
    kept = KeptTables(t.spark, t.folder, _folder(t), _COST_COLUMNS)
    return headline.headline_costs(
        MODELS["l08_routing_savings"](kept), REPORTS["r12_failure_cost"](kept), REPORTS["r06_model_task_matrix"](kept)
    )


HEADLINE: dict[str, Query] = {
    "m01_headline_growth": lambda t: headline.headline_growth(
        REPORTS["r01_monthly_kpis"](t), REPORTS["r02_nrr_grr"](t)
    ),
    "m02_headline_margins": lambda t: headline.headline_margins(
        PRICING["p01_margin_by_plan"](t), REPORTS["r07_migration_pairs"](t), REPORTS["r09_task_cost_per_credit"](t)
    ),
    "m03_headline_channels": lambda t: headline.headline_channels(REPORTS["r05_channel_performance"](t)),
    "m04_activation_lift": lambda t: headline.activation_lift(CUSTOMERS["c02_activation_threshold"](t)),
    "m05_strongest_driver": lambda t: headline.strongest_driver(CUSTOMERS["c05_hazard_odds_ratios"](t)),
    "m06_headline_costs": _headline_costs,
    "m07_scenario_best": lambda t: headline.scenario_best(PRICING["p10_pricing_scenarios"](t)),
    "m08_retention_matrix": lambda t: headline.retention_cells(REPORTS["r03_cohort_retention"](t)),
    "m08_month_6_average": lambda t: headline.month_n_average(REPORTS["r03_cohort_retention"](t), 6),
    "m08_month_3_average": lambda t: headline.month_n_average(
        FILTERED["d05_cohort_retention_any"](t), 3, "retention"
    ),
    "m09_model_task_matrix_wide": lambda t: headline.model_task_cells(REPORTS["r06_model_task_matrix"](t)),
    "m10_km_steps": lambda t: headline.km_steps(CUSTOMERS["c09_km_by_activation"](t)),
    "m10_km_gap": lambda t: headline.km_gap(CUSTOMERS["c09_km_by_activation"](t)),
    "m11_persona_minmax": lambda t: headline.persona_minmax(CUSTOMERS["c15_name_personas"](t)),
    "m12_arm_wald_ci": lambda t: headline.arm_wald_ci(_experiment(t)),
    "m13_outcome_by_activation": lambda t: headline.outcome_by_activation(
        FILTERED["d06_activation_by_customer"](t)
    ),
    "m14_format_p": lambda t: headline.labelled_p_values(MODELS["l04_chi_square"](t)).select(
        "degrees_of_freedom", "n_observations", "p_label"
    ),
}


def _domain(t: Tables) -> dict[str, DataFrame]:
    return {
        "plans": t.plans,
        "models": t.models,
        "customers": t.customers,
        "customer_months": t.customer_months,
        "agent_runs": t.runs,
        "experiment_assignments": t.experiment_assignments,
    }


def _table_sizes(t: Tables) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [f.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n, f in _domain(t).items()],
    )


def _folder(t: Tables) -> str:
    """A new folder below the one the cluster shares."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _sizes(frames: dict[str, DataFrame]) -> DataFrame:
    counts = [f.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n, f in frames.items()]
    return reduce(DataFrame.unionByName, counts)


def _loaded_tables(t: Tables) -> DataFrame:
    """IO1: the domain tables written, then loaded with their declared schemas."""
    folder = _folder(t)
    for name, frame in (_domain(t) | {"agent_runs": t.agent_runs}).items():
        frame.select(*TABLES[name].names).write.parquet(f"{folder}/{name}")
    loaded = tables.load_tables(t.spark, folder)
    cost = loaded["agent_runs"].agg(F.sum("llm_cost_usd").cast("double").alias("total_llm_cost_usd"))
    return _sizes(loaded).join(cost, F.col("table_name") == "agent_runs", "left")


def _digest(name: str, frame: DataFrame) -> DataFrame:
    """Contents of a table in a form any engine can compute: per column, values, their sum, and the length of what is text."""
    flat = plain(frame)
    cells = flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in flat.columns])).alias("x")).select("x.*")
    number = F.expr("try_cast(value AS double)")
    return cells.where("value IS NOT NULL").groupBy("name").agg(
        F.count("value").alias("n_values"), F.sum(number).alias("total"),
        F.sum(F.when(number.isNull(), F.length("value"))).alias("text_length"),
    ).select(F.lit(name).alias("table_name"), "name", "n_values", "total", "text_length")


def _report_files(t: Tables) -> DataFrame:
    """IO3, IO4: all twelve reports written, then read again; a digest of every column. The reports share their tables."""
    folder = _folder(t)
    kept = KeptTables(t.spark, t.folder, _folder(t), _REPORT_COLUMNS)
    written = sinks.run_report_catalog({name: (lambda q=query: q(kept)) for name, query in REPORTS.items()}, folder)
    return reduce(DataFrame.unionByName, [_digest(name, t.spark.read.parquet(f"{folder}/{name}")) for name in written])


def _benchmark_results(t: Tables) -> DataFrame:
    """IO2: attempts as CSV with a header, read again with the declared schema; a digest of every column."""
    folder = f"{_folder(t)}/attempts.csv"
    t.attempts.withColumn("repeat", F.lit(1)).select(*ATTEMPTS_SCHEMA.names).write.option("header", True).csv(folder)
    loaded = tables.load_benchmark_results(t.spark, folder)
    return _digest("attempts", loaded.drop("repeat", "timestamp"))


def _star_files(t: Tables) -> DataFrame:
    """IO5: the star schema as CSV, read again. Its tables are derived from lines that met their orders once."""
    kept = StarTables(t.spark, t.folder, _folder(t))
    with sinks.shuffles_freed(t.spark):
        built = star.star_schema(
            kept.customers, kept.plans, kept.models, kept.customer_months, kept.agent_runs, kept.keyed_runs, kept.customer_dim
        )
        written = sinks.write_star_schema(built, _folder(t), compression="gzip", as_read=["fact_agent_runs"])
    return _sizes({name: t.spark.read.csv(path, header=True) for name, path in written.items()})


SOURCES: dict[str, Query] = {
    "io1_table_sizes": _table_sizes,
    "io1_loaded_tables": _loaded_tables,
    "io2_benchmark_results": _benchmark_results,
    "io4_report_files": _report_files,
    "io5_star_files": _star_files,
    "io6_sanitize_text": lambda t: sinks.sanitize_text(t.raw("documents").select("doc_id", "text", "lang", "source")),
    "io7_filter_options": lambda t: tables.filter_options_frame(_domain(t)),
}

QUERIES: dict[str, Query] = {
    **SOURCES,
    **REPORTS,
    **CUSTOMERS,
    **MODELS,
    **PRICING,
    **FILTERED,
    **WHAT_IF,
    **STAR,
    **ATTEMPTS,
    **QUALITY,
    **HEADLINE,
}
