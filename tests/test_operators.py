import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from usagelens.operators import attempts, customers, filtered, headline, models, pricing, quality, reports, star, usage, whatif
from usagelens.plans.mapping import EXPERIMENT_END, EXPERIMENT_NAME, EXPERIMENT_START
from usagelens.schemas import TABLES

D = dt.date


def rows(frame, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r.asDict() for r in frame.collect()}


def test_mapping_follows_the_declared_schemas(tables):
    for name, schema in TABLES.items():
        frame = getattr(tables, name)
        for field in schema.fields:
            assert frame.schema[field.name].dataType == field.dataType, (name, field.name)


# -- activation ------------------------------------------------------------------------


def test_first_runs_break_time_ties_by_run_id(make):
    runs = make.runs(*[dict(customer_id="a", status="success" if i < 5 else "failed") for i in range(9)])
    assert usage.activation_counts(runs).collect()[0]["successes"] == 5
    assert {r["run_id"] for r in usage.first_runs(runs.repartition(4)).collect()} == {f"R{i:04d}" for i in range(5)}


def test_activation_window_rules(make):
    runs = make.runs(
        *[dict(customer_id="full", status="success")] * 3,
        *[dict(customer_id="full", status="failed")] * 2,
        dict(customer_id="short", status="success"),
    )
    assert {r["customer_id"] for r in usage.activation_counts(runs, require_full_window=True).collect()} == {"full"}
    scores = rows(usage.activation_scores(runs), "customer_id")
    assert scores["full"]["activation_score"] == 0.6 and scores["short"]["activation_score"] == 1.0


def test_six_month_retention_is_unknown_beyond_the_data(make):
    people = make.customers(
        dict(customer_id="kept", first_paid_date=D(2025, 1, 20)),
        dict(customer_id="lost", first_paid_date=D(2025, 1, 3)),
        dict(customer_id="late", first_paid_date=D(2025, 3, 3)),
        dict(customer_id="free"),
    )
    months = make.months(
        dict(customer_id="kept", month=D(2025, 7, 1)),
        dict(customer_id="lost", month=D(2025, 7, 1), plan="Free"),
        dict(customer_id="late", month=D(2025, 8, 1)),
    )
    got = {r["customer_id"]: r["retained_6mo"] for r in usage.six_month_retention(people, months).collect()}
    assert got == {"kept": 1, "lost": 0, "late": None}


def test_activation_threshold_lists_every_cutoff(make):
    runs = make.runs(*[dict(customer_id="a", status="success")] * 5)
    people = make.customers(dict(customer_id="a", first_paid_date=D(2025, 1, 20)))
    got = rows(customers.activation_threshold(runs, people, make.months(dict(customer_id="a"))), "min_successes_of_5")
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert all(r["n_customers_at_or_above"] == 1 and r["self_serve_conversion_rate"] == 1.0 for r in got.values())
    assert got[5]["retained_6mo_rate"] is None


# -- billing ---------------------------------------------------------------------------


def test_growth_uses_the_previous_row_and_nrr_the_calendar(make):
    months = make.months(
        dict(customer_id="a", month=D(2025, 1, 1), revenue_usd=Decimal(100), monthly_fee_usd=Decimal(100)),
        dict(customer_id="b", month=D(2025, 1, 1), revenue_usd=Decimal(50), monthly_fee_usd=Decimal(50)),
        dict(customer_id="a", month=D(2025, 3, 1), revenue_usd=Decimal(90), monthly_fee_usd=Decimal(90)),
        dict(customer_id="a", month=D(2025, 4, 1), revenue_usd=Decimal(120), monthly_fee_usd=Decimal(120)),
    )
    kpis = rows(reports.monthly_kpis(months, make.customers(dict(customer_id="a"))), "month")
    assert kpis[D(2025, 3, 1)]["mrr_mom_growth_pct"] == pytest.approx(-40)
    assert kpis[D(2025, 1, 1)]["mrr_mom_growth_pct"] is None
    nrr = rows(reports.nrr_grr(months), "month")
    assert nrr[D(2025, 2, 1)]["nrr_pct"] == 0.0  # the gap month keeps nothing
    assert nrr[D(2025, 4, 1)]["nrr_pct"] == pytest.approx(120 / 90 * 100)
    assert nrr[D(2025, 4, 1)]["grr_pct"] == 100.0
    assert D(2025, 5, 1) not in nrr
    # the filterable NRR instead pairs consecutive present months
    average = filtered.nrr_average(months, make.customers(dict(customer_id="a"), dict(customer_id="b"))).collect()[0]["nrr"]
    assert average == pytest.approx((90 / 150 + 120 / 90) / 2)


def test_nrr_average_needs_two_months(make):
    months = make.months(dict(customer_id="a"))
    assert filtered.nrr_average(months, make.customers(dict(customer_id="a"))).collect()[0]["nrr"] is None


def test_costs_without_billing_month_are_left_out_of_plan_margins_but_not_of_lifetime_margins(make):
    months = make.months(dict(customer_id="a", credits_used=4), dict(customer_id="z", revenue_usd=Decimal(0)))
    runs = make.runs(
        dict(customer_id="a", llm_cost_usd=Decimal(5)),
        dict(customer_id="a", llm_cost_usd=Decimal(7), started_at=dt.datetime(2025, 2, 2)),
    )
    plan = rows(reports.unit_economics_plan(months, runs), "plan")["Pro"]
    assert plan["total_llm_cost_usd"] == 5 and plan["paying_customers"] == 2
    lifetime = rows(reports.customer_margin(months, runs), "customer_id")
    assert set(lifetime) == {"a"}
    assert lifetime["a"]["llm_cost_usd"] == 12
    people = make.customers(dict(customer_id="a"), dict(customer_id="z"))
    filtered_margin = rows(filtered.margin_deciles(months, runs, people), "customer_id")
    assert filtered_margin["a"]["llm_cost"] == 5 and filtered_margin["a"]["decile"] == 1


def test_plan_without_revenue_has_no_margin(make):
    months = make.months(dict(customer_id="a", plan="Team", revenue_usd=Decimal(0)))
    row = reports.unit_economics_plan(months, make.runs(dict(customer_id="b"))).collect()[0]
    assert row["gross_margin_pct"] is None and row["llm_cost_per_credit_usd"] is None


def test_channel_without_self_serve_signups_ranks_last(make):
    people = make.customers(
        dict(customer_id="a", acquisition_channel="Outbound", is_sales_led=1, first_paid_date=D(2025, 1, 5)),
        dict(customer_id="b", acquisition_channel="Organic", first_paid_date=D(2025, 1, 5), status="churned"),
        dict(customer_id="c", acquisition_channel="Free only"),
    )
    got = rows(reports.channel_performance(people, make.months(dict(customer_id="a"))), "acquisition_channel")
    assert got["Outbound"]["self_serve_conversion_pct"] is None
    assert [got[c]["conversion_rank"] for c in ("Organic", "Free only", "Outbound")] == [1, 2, 3]
    assert got["Free only"]["retention_rank"] == 1  # undefined churn comes first, ascending
    assert got["Organic"]["retention_rank"] == 3


def test_most_common_plan_breaks_ties_by_name(make):
    ids = [f"c{i}" for i in range(4)]
    months = make.months(*[dict(customer_id=i) for i in ids])
    people = make.customers(*[dict(customer_id=i, current_plan=p) for i, p in zip(ids, ["Team", "Team", "Pro", "Pro"])])
    got = reports.customer_margin_deciles(months, make.runs(dict(customer_id="c0")), people).collect()
    assert sum(r["customers"] for r in got) == 4
    ranked = reports.customer_margin(months, make.runs(dict(customer_id="x"))).withColumn("d", F.lit(1))
    assert ranked.count() == 4


# -- models ----------------------------------------------------------------------------


def test_nearest_rank_latency(make):
    runs = make.runs(*[dict(customer_id="a", latency_sec=float(x)) for x in (5, 1, 1, 9, 3, 7, 2, 8, 4, 6)])
    untimed = make.runs(dict(customer_id="b", latency_sec=None))
    row = reports.model_task_matrix(runs.unionByName(untimed)).collect()[0]
    ordered = sorted([5, 1, 1, 9, 3, 7, 2, 8, 4, 6])
    assert row["p50_latency_sec"] == ordered[5] and row["p90_latency_sec"] == ordered[9]
    assert row["n_runs"] == 11


def test_group_without_success_has_no_cost_per_success(make):
    row = reports.model_task_matrix(make.runs(dict(customer_id="a", status="failed"))).collect()[0]
    assert row["cost_per_success_usd"] is None and row["failed_pct"] == 100


def simpson_runs(make):
    cells = {("hard", "m1"): (80, 30), ("easy", "m1"): (20, 19), ("hard", "m2"): (20, 6), ("easy", "m2"): (80, 72)}
    return make.runs(
        *[
            dict(customer_id="a", task_type=t, model=m, status="success" if i < ok else "failed")
            for (t, m), (n, ok) in cells.items()
            for i in range(n)
        ]
    )


def test_reversal_is_flagged(make):
    row = models.simpsons_reversal(simpson_runs(make)).collect()
    assert len(row) == 1
    assert (row[0]["model_a"], row[0]["pooled_winner"]) == ("m2", "m2")
    assert row[0]["pct_task_strata_agreeing_with_pooled_winner"] == 0.0 and row[0]["reversal_flag"] is True


def test_models_without_a_common_task_are_still_paired(make):
    runs = make.runs(dict(customer_id="a", task_type="x", model="m1"), dict(customer_id="a", task_type="y", model="m2", status="failed"))
    row = models.simpsons_reversal(runs).collect()[0]
    assert row["pct_task_strata_agreeing_with_pooled_winner"] is None and row["reversal_flag"] is False


def test_frontier_equals_pairwise_dominance(make):
    import random

    rng = random.Random(3)
    runs = make.runs(
        *[
            dict(
                customer_id="a",
                task_type=f"t{rng.randrange(3)}",
                model=f"m{rng.randrange(8)}",
                llm_cost_usd=Decimal(rng.randrange(1, 4)),
                status=rng.choice(["success", "failed"]),
            )
            for _ in range(150)
        ]
    )
    got = models.cost_quality_frontier(runs).collect()
    for r in got:
        dominated = any(
            o["avg_cost_usd"] <= r["avg_cost_usd"]
            and o["success_rate"] >= r["success_rate"]
            and (o["avg_cost_usd"] < r["avg_cost_usd"] or o["success_rate"] > r["success_rate"])
            for o in got
            if o["task_type"] == r["task_type"]
        )
        assert r["on_pareto_frontier"] is not dominated


def test_routing_picks_the_cheapest_within_tolerance(make):
    def block(model, n_ok, n, cost):
        return [dict(customer_id="a", model=model, status="success" if i < n_ok else "failed", llm_cost_usd=Decimal(cost)) for i in range(n)]

    runs = make.runs(*block("best", 100, 100, 9), *block("near", 99, 100, 2), *block("cheap", 50, 100, 1))
    got = rows(models.routing_policy(runs, replicates=200), "model")
    assert [m for m, r in got.items() if r["is_recommended"]] == ["near"]
    assert [m for m, r in got.items() if r["is_current_best_success"]] == ["best"]
    assert got["cheap"]["success_rate_ci_low"] < 0.5 < got["cheap"]["success_rate_ci_high"]
    saved = models.routing_savings(runs).collect()[0]
    assert saved["recommended_model"] == "near" and saved["routing_action"] == "route_to_cheaper_model"
    assert saved["monthly_dollar_impact_usd"] == pytest.approx((4 - 2) * 300)


# -- pricing ---------------------------------------------------------------------------


def test_rerouted_cost_is_unknown_without_balanced_runs(make):
    runs = make.runs(dict(customer_id="a", task_type="bug_fix"), dict(customer_id="a", task_type="code_migration"))
    got = rows(pricing.pricing_scenarios(make.months(dict(customer_id="a", credits_used=10)), runs), "scenario")
    assert got["route_simple_tasks_to_balanced_medium"]["total_llm_cost_usd"] is None
    assert got["complexity_weighted_migration_credits"]["total_revenue_usd"] == pytest.approx(29 + 4 * 2.9)
    assert got["pro_39"]["total_revenue_usd"] == 39


def test_already_repriced_customers_can_be_excluded(make):
    months = make.months(dict(customer_id="a"), dict(customer_id="b"))
    assigned = make.assignments(dict(customer_id="b", variant="treatment", pro_price_shown=39))
    runs = make.runs(dict(customer_id="a"))
    got = rows(pricing.pricing_scenarios(months, runs, assigned, exclude_already_repriced=True), "scenario")
    assert got["pro_39"]["total_revenue_usd"] == 58 + 10


def test_conversion_bounds(make):
    people = make.customers(
        dict(customer_id="before", first_paid_date=D(2024, 12, 1)),
        dict(customer_id="in", first_paid_date=D(2025, 1, 31)),
        dict(customer_id="after", first_paid_date=D(2025, 2, 1)),
        dict(customer_id="never"),
    )
    assigned = make.assignments(*[dict(customer_id=c) for c in ("before", "in", "after", "never")])
    loose = rows(reports.assigned_conversions(assigned, people, "e"), "customer_id")
    strict = rows(reports.assigned_conversions(assigned, people, "e", min_days=0), "customer_id")
    assert {c: r["converted"] for c, r in loose.items()} == {"before": 1, "in": 1, "after": 0, "never": 0}
    assert {c: r["converted"] for c, r in strict.items()} == {"before": 0, "in": 1, "after": 0, "never": 0}


def test_early_revenue_counts_three_calendar_months_of_converters(make):
    people = make.customers(dict(customer_id="a", first_paid_date=D(2025, 1, 15)), dict(customer_id="b"))
    assigned = make.assignments(dict(customer_id="a"), dict(customer_id="b"))
    months = make.months(
        *[dict(customer_id="a", month=D(2025, m, 1), revenue_usd=Decimal(m)) for m in (1, 2, 3, 4)], dict(customer_id="b")
    )
    got = rows(pricing.experiment_frame(assigned, people, months, "e"), "customer_id")
    assert got["a"]["revenue_first_3mo_usd"] == 6 and got["b"]["revenue_first_3mo_usd"] == 0


# -- filters ---------------------------------------------------------------------------

OPTIONS = {"months": ["2025-01-01"], "plans": ["Pro"], "regions": ["EU", "US"], "channels": ["Organic"], "industries": ["A"]}


def test_filters_keep_only_listed_values():
    built = filtered.Filters.build(OPTIONS, plans=["Pro", "Gold"], regions=["'; DROP TABLE customers; --"])
    assert built == filtered.Filters(plans=("Pro",))
    with pytest.raises(TypeError):
        filtered.Filters.build(OPTIONS, colour=["red"])


@pytest.fixture(scope="module")
def narrow(tables):
    return filtered.Filters(
        months=("2025-06-01", "2025-07-01", "2025-08-01"), plans=("Pro", "Team"), regions=("ASIA", "EUROPE"),
        channels=("Organic", "Referral"),
    )


def test_filtered_financials_match_pandas(tables, narrow):
    people = tables.customers.toPandas()
    people = people[people.region.isin(narrow.regions) & people.acquisition_channel.isin(narrow.channels)]
    months = tables.customer_months.toPandas()
    months["m"] = months.month.astype(str)
    months = months[months.customer_id.isin(people.customer_id) & months.m.isin(narrow.months) & months.plan.isin(narrow.plans)]
    cost = tables.runs.select("customer_id", F.trunc("started_at", "month").alias("month"), F.col("llm_cost_usd").cast("double").alias("c")).toPandas()
    cost = cost.groupby(["customer_id", "month"]).c.sum().reset_index()
    merged = months.merge(cost, on=["customer_id", "month"], how="left").fillna({"c": 0.0})
    want = merged.groupby("m").agg(n=("customer_id", "nunique"), revenue=("revenue_usd", "sum"), cost=("c", "sum"))
    got = rows(filtered.monthly_financials(tables.customer_months, tables.runs, tables.customers, narrow), "month")
    assert {str(m) for m in got} == set(want.index) and len(got) == 3
    for m, r in got.items():
        assert r["active_paid_customers"] == want.n[str(m)]
        assert r["revenue"] == want.revenue[str(m)]
        assert float(r["llm_cost"]) == pytest.approx(want.cost[str(m)])


def test_filtered_run_queries_match_pandas(tables, narrow):
    people = tables.customers.toPandas()
    people = people[people.region.isin(narrow.regions) & people.acquisition_channel.isin(narrow.channels)]
    runs = tables.agent_runs.select("customer_id", "status", "plan_at_run", "model", "task_type", F.trunc("started_at", "month").cast("string").alias("m")).toPandas()
    runs = runs[runs.customer_id.isin(people.customer_id) & runs.m.isin(narrow.months)]
    by_model = runs.groupby(["model", "task_type"]).size()
    got = rows(filtered.model_task_success(tables.runs, tables.customers, narrow), "model", "task_type")
    assert {k: r["n_runs"] for k, r in got.items()} == by_model.to_dict()
    on_plan = runs[runs.plan_at_run.isin(narrow.plans)]
    want = on_plan.assign(ok=on_plan.status == "success").groupby("m").ok.mean()
    rates = rows(filtered.run_success_rate(tables.agent_runs, tables.customers, narrow), "month")
    assert {str(m): r["success_rate"] for m, r in rates.items()} == pytest.approx(want.to_dict())


def test_all_invalid_selection_means_everything(tables):
    nothing = filtered.Filters.build(OPTIONS, regions=["MOON"])
    a = filtered.cost_per_success(tables.runs, tables.customers, nothing).collect()
    b = filtered.cost_per_success(tables.runs, tables.customers).collect()
    assert sorted(a) == sorted(b)


def test_failure_tax_of_no_runs_is_zero(make):
    runs = make.runs(dict(customer_id="stranger"))
    row = filtered.failure_tax(runs, make.customers(dict(customer_id="a"))).collect()[0].asDict()
    assert row == {"failed_cost": 0.0, "total_cost": 0.0, "share": 0.0, "n_failed": 0, "n_runs": 0}


def test_routing_what_if_without_balanced_runs(make):
    runs = make.runs(
        dict(customer_id="a", model="frontier-large", llm_cost_usd=Decimal(10)),
        dict(customer_id="a", model="frontier-large", task_type="refactor", llm_cost_usd=Decimal(6)),
        dict(customer_id="a", model="balanced-medium", llm_cost_usd=Decimal(4)),
    )
    got = rows(filtered.routing_what_if(runs, make.customers(dict(customer_id="a"))), "pct")
    assert len(got) == 21 and got[0]["savings_usd"] == 0
    assert got[100]["new_cost_usd"] == pytest.approx(4) and got[100]["new_success_rate"] == pytest.approx(0.5)


# -- what-if ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def baseline(tables):
    frame = whatif.simulator_baseline(
        tables.plans, tables.customers, tables.customer_months, tables.runs, tables.experiment_assignments, EXPERIMENT_NAME
    )
    return frame.persist()


def test_default_inputs_change_nothing(baseline):
    got = whatif.pricing_what_if(baseline).collect()
    assert len(got) == 4 and all(r["delta_pp"] == 0.0 for r in got)


def test_price_moves_only_its_plan(baseline):
    base = rows(whatif.pricing_what_if(baseline), "plan")
    moved = rows(whatif.pricing_what_if(baseline, {"Pro": 40.0}), "plan")
    elasticity = baseline.first()["elasticity"]
    assert (moved["Pro"]["customers"] < base["Pro"]["customers"]) == (elasticity < 0)
    assert moved["Team"] == base["Team"]
    total = moved[whatif.TOTAL_ROW]
    assert total["revenue"] == pytest.approx(sum(r["revenue"] for p, r in moved.items() if p != whatif.TOTAL_ROW))


def test_status_quo_scenario_has_no_delta(baseline):
    grid = rows(whatif.scenario_grid(baseline), "scenario")
    assert grid["Status Quo"]["delta_vs_status_quo_pp"] == 0.0 and len(grid) == 4


# -- churn and personas ----------------------------------------------------------------


def test_panel_censoring(make):
    people = make.customers(
        dict(customer_id="active"), dict(customer_id="gone", status="churned", churn_date=D(2025, 2, 28)), dict(customer_id="paused")
    )
    months = make.months(
        *[dict(customer_id="active", month=D(2025, m, 1)) for m in (1, 2, 3)],
        *[dict(customer_id="gone", month=D(2025, m, 1)) for m in (1, 2)],
        dict(customer_id="paused", month=D(2025, 1, 1)),
    )
    runs = make.runs(dict(customer_id="gone", status="failed"), dict(customer_id="gone", task_type="code_migration"))
    got = rows(customers.survival_panel(months, people, runs), "customer_id", "month")
    assert ("active", D(2025, 3, 1)) not in got and len(got) == 5
    assert {k: r["churned_event"] for k, r in got.items() if r["churned_event"]} == {("gone", D(2025, 2, 1)): 1}
    lagged = got[("gone", D(2025, 2, 1))]
    assert (lagged["prior_month_n_runs"], lagged["prior_month_failure_rate"], lagged["prior_month_migration_share"]) == (2, 0.5, 0.5)
    assert got[("active", D(2025, 1, 1))]["prior_month_n_runs"] == 0


@pytest.fixture(scope="module")
def panel(tables):
    return customers.survival_panel(tables.customer_months, tables.customers, tables.runs).persist()


def test_hazard_model_reports_every_feature(panel):
    odds = rows(customers.hazard_odds_ratios(panel), "feature")
    assert "acquisition_channel_Community" not in odds and "plan_Enterprise" not in odds
    assert {"plan_Pro", "plan_Team", "tenure_months", "activation_score"} <= set(odds)
    for r in odds.values():
        assert r["odds_ratio_ci_low"] <= r["odds_ratio"] <= r["odds_ratio_ci_high"] and 0 <= r["p_value"] <= 1


def test_holdout_auc_is_a_probability(panel):
    summary = customers.churn_model_summary(panel).collect()[0]
    assert 0 < summary["holdout_roc_auc"] < 1
    assert summary["n_panel_rows"] == panel.count()


def test_personas(tables):
    features = customers.customer_usage_features(tables.customers, tables.runs, tables.customer_months)
    assigned, profile, diagnostics = customers.personas(features, ks=(3, 4), restarts=2)
    assert [r["k"] for r in diagnostics.orderBy("k").collect()] == [3, 4]
    names = [r["persona_name"] for r in profile.collect()]
    assert len(names) == len(set(names))
    assert assigned.count() == features.where("ever_paid").count()
    scaled = headline.persona_minmax(profile).collect()
    assert all(0 <= v <= 1 for r in scaled for v in r[1:])


def test_personas_without_a_paying_customer(tables):
    features = customers.customer_usage_features(tables.customers, tables.runs, tables.customer_months)
    for frame in customers.personas(features.where("NOT ever_paid"), ks=(3, 4), restarts=2):
        assert frame.count() == 0


def test_persona_names_follow_the_rules(spark):
    fields = "cluster int, migration_share double, lifetime_revenue_usd double, avg_monthly_runs double, failure_rate double, activation_score double"
    profile = spark.createDataFrame(
        [
            (0, 0.9, 1000.0, 50.0, 0.10, 0.7),
            (1, 0.1, 100.0, 10.0, 0.10, 0.7),
            (2, 0.1, 90.0, 10.0, 0.10, 0.7),
            (3, 0.1, 300.0, 10.0, 0.30, 0.1),
        ],
        fields,
    )
    names = {r["cluster"]: r["persona_name"] for r in customers.name_personas(profile).collect()}
    assert names == {
        0: "Migration-Heavy Enterprise",
        1: "Light Self-Serve Reliable",
        2: "Light Self-Serve Reliable (Segment 2)",
        3: "Failure-Prone At-Risk",
    }


def test_identical_profiles_are_steady(spark):
    row = (0.2, 100.0, 10.0, 0.1, 0.7)
    fields = "cluster int, migration_share double, lifetime_revenue_usd double, avg_monthly_runs double, failure_rate double, activation_score double"
    profile = spark.createDataFrame([(0, *row), (1, *row)], fields)
    assert sorted(r["persona_name"] for r in customers.name_personas(profile).collect()) == [
        "Steady Moderate User",
        "Steady Moderate User (Segment 2)",
    ]


def test_strongest_driver_prefers_significant_features(spark):
    odds = spark.createDataFrame(
        [("big", 9.0, 0.4), ("low", 0.4, 0.01), ("high", 2.0, 0.02)], "feature string, odds_ratio double, p_value double"
    )
    assert headline.strongest_driver(odds).collect()[0]["feature"] == "low"
    none = odds.where("feature = 'big'")
    assert headline.strongest_driver(none).collect()[0]["p_label"] == "p=0.400"


# -- quality and star ------------------------------------------------------------------


def test_quality_rules_find_planted_faults(make):
    people = make.customers(
        dict(customer_id="a", churn_date=D(2025, 1, 31), status="churned"), dict(customer_id="a"), dict(customer_id="s", is_sales_led=1)
    )
    runs = make.runs(
        dict(customer_id="ghost", run_id="R1", steps=-1, tests_passed=3, human_rating=6, status="odd"),
        dict(customer_id="a", run_id="R1", started_at=dt.datetime(2024, 12, 31)),
        dict(customer_id="a", run_id="R2", started_at=dt.datetime(2025, 2, 1, 0, 0, 1)),
    )
    months = make.months(
        dict(customer_id="a", revenue_usd=Decimal(30), credits_used=-1), dict(customer_id="a", plan="Free"), dict(customer_id="ghost")
    )
    assigned = make.assignments(
        dict(customer_id="s", assigned_at=D(2024, 1, 1)), dict(customer_id="ghost", variant="treatment", assigned_at=D(2025, 3, 1))
    )
    report = quality.quality_report(people, runs, months, assigned, (EXPERIMENT_START, EXPERIMENT_END), {"control": 29, "treatment": 39})
    got = {r["rule"]: r["violations"] for r in report.collect()}
    assert len(got) == 18
    doubled = {"q13_runs_not_before_signup": 2}  # both rows of the duplicated customer
    assert {k: v for k, v in got.items() if k not in doubled} == {k: 1 for k in got if k not in doubled}
    assert got["q13_runs_not_before_signup"] == 2


def test_quality_rules_count_missing_values(make):
    people = make.customers(dict(customer_id="a", signup_date=D(2024, 12, 1)))
    runs = make.runs(*[dict(customer_id="a", run_id=f"R{i}", **{c: None}) for i, c in enumerate(["llm_cost_usd", "tests_passed", "status", "started_at"])])
    months = make.months(dict(customer_id="a", plan=None), dict(customer_id="a", month=D(2025, 2, 1), credits_used=None), dict(customer_id="a", month=D(2025, 3, 1), revenue_usd=None))
    assigned = make.assignments(dict(customer_id="a", assigned_at=None), dict(customer_id="a", assigned_at=D(2025, 3, 1), pro_price_shown=None))
    report = quality.quality_report(people, runs, months, assigned, (EXPERIMENT_START, EXPERIMENT_END), {"control": 29, "treatment": 39})
    broken = {r["rule"][:3] for r in report.collect() if r["violations"] == 1}
    assert broken == {"q07", "q08", "q10", "q11", "q13", "q14", "q15", "q17", "q18"}


def test_quality_rules_count_days_and_missing_keys(make):
    people = make.customers(dict(customer_id="a", churn_date=D(2025, 1, 31)), dict(customer_id="hot"), dict(customer_id=None))
    moments = [(2025, 1, 4, 23, 59), (2025, 1, 5), (2025, 1, 31, 12), (2025, 2, 1), (2025, 2, 1, 0, 1), (2025, 2, 2)]
    runs = make.runs(
        *[dict(customer_id="a", started_at=dt.datetime(*m)) for m in moments],
        *[dict(customer_id="hot", run_id=f"H{i % 40}", started_at=dt.datetime(2025, 3, 1 + i % 2, i % 24)) for i in range(60)],
        dict(customer_id=None), dict(customer_id=None, run_id=None), dict(customer_id="ghost", run_id=None),
    )
    window, prices = (EXPERIMENT_START, EXPERIMENT_END), {"control": 29, "treatment": 39}
    report = quality.quality_report(people, runs, make.months(dict(customer_id=None)), make.assignments(dict(customer_id=None)), window, prices)
    got = {r["rule"][:3]: r["violations"] for r in report.collect()}
    # H0 to H19 twice, the missing run id twice; customers: missing and ghost
    assert (got["q02"], got["q03"], got["q04"], got["q05"]) == (21, 2, 1, 1)
    # midnight after the churn day still counts as in time
    assert (got["q13"], got["q14"]) == (1, 2)
    empty = quality.quality_report(*[t.where("false") for t in (people, runs, make.months(), make.assignments())], window, prices)
    assert {r["violations"] for r in empty.collect()} == {0} and empty.count() == 18


def test_wide_tables_take_their_columns_from_the_data(spark):
    cohort = spark.range(31).selectExpr("'2025-01-01' AS cohort_month", "id AS months_since_signup", "100.0 - id AS retention_pct")
    wide = headline.retention_matrix(cohort).collect()[0]
    assert len(wide) == 32 and wide["m30"] == 70
    cells = spark.range(5).selectExpr("'bug_fix' AS task_type", "concat('model-', id) AS model", "10.0 * id AS success_pct")
    row = headline.model_task_wide(cells).collect()[0]
    assert row["model-4"] == 40 and row["spread_pp"] == 40
    tried = spark.createDataFrame([("m", "success"), ("m", "timeout"), ("n", "failed"), ("n", None)], "model string, status string")
    got = {r["model"]: r.asDict() for r in attempts.contingency(tried).collect()}
    assert got["n"] == {"model": "n", "failed": 1, "success": 0, "timeout": 0, "unknown": 1} and got["m"]["timeout"] == 1


def test_star_measures_rank_time_ties_together(spark, make):
    facts = make.runs(*[dict(customer_id="1", status="success" if i < 3 else "failed") for i in range(8)]).withColumnRenamed(
        "customer_id", "customer_key"
    )
    row = star.star_run_measures(facts).collect()[0]
    assert row["success_rate"] == pytest.approx(3 / 8) and row["activation_rate"] == 0.0


def test_star_measures_keep_a_crowded_second_as_one_row(spark):
    i = F.col("id")
    # customer a: 4 early runs, then 20,000 in one second (all of rank 5), then later ones; others have few runs
    crowd = spark.range(20_010).select(
        F.when(i < 20_008, "a").otherwise("b").alias("customer_key"),
        F.timestamp_seconds(F.when(i < 4, i).when(i < 20_004, 10).otherwise(i)).alias("started_at"),
        F.when((i >= 4) & (i < 15_004) | (i == 20_008), "success").otherwise("failed").alias("status"),
        F.lit(1).cast("decimal(18,6)").alias("llm_cost_usd"),
    ).repartition(7)
    ranked = crowd.withColumn("r", F.rank().over(Window.partitionBy("customer_key").orderBy("started_at"))).where("r <= 5")
    shares = {r["customer_key"]: r["share"] for r in ranked.groupBy("customer_key").agg(
        (F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("share")).collect()}
    assert shares["a"] == pytest.approx(15_000 / 20_004) and shares["b"] == 0.5
    assert star.star_run_measures(crowd).first()["activation_rate"] == 0.5
    assert star.star_run_measures(crowd.where("customer_key = 'a'")).first()["activation_rate"] == 1.0
    assert star.star_run_measures(crowd.where("false")).first()["activation_rate"] is None


# -- invariance ------------------------------------------------------------------------


def test_results_do_not_depend_on_partitioning_or_row_order(tables):
    runs, months = tables.runs, tables.customer_months
    shuffled = runs.orderBy(F.xxhash64("run_id")).repartition(13)
    a = rows(reports.unit_economics_plan(months, runs), "plan")
    b = rows(reports.unit_economics_plan(months.repartition(5, "month"), shuffled), "plan")
    assert a == b
    first_a = rows(usage.activation_scores(runs), "customer_id")
    assert first_a == rows(usage.activation_scores(shuffled), "customer_id")
