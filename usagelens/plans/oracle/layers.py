"""DuckDB SQL for the filtered (D), what-if (X), star (S), attempt (B), quality (Q), headline (M) and IO queries."""

from usagelens.plans.mapping_sql import with_mapping
from usagelens.plans.oracle.analytics import (
    AB,
    CHI_TAIL,
    KM_ACTIVATION,
    SAVINGS,
    chi2_ctes,
    phi,
)
from usagelens.plans.oracle.analytics import CUSTOMERS as CUSTOMER_SQL
from usagelens.plans.oracle.analytics import PRICING as PRICING_SQL
from usagelens.plans.oracle.reports import REPORTS as REPORT_SQL

_FIN = """fin AS (SELECT month, count(DISTINCT customer_id) AS active_paid_customers, sum(monthly_fee_usd)::DOUBLE AS mrr,
                    sum(revenue_usd)::DOUBLE AS revenue, sum(llm_cost_usd)::DOUBLE AS llm_cost,
                    (sum(revenue_usd)::DOUBLE - sum(llm_cost_usd)::DOUBLE) / NULLIF(sum(revenue_usd)::DOUBLE, 0) AS gross_margin
             FROM cost_months WHERE plan <> 'Free' GROUP BY month)"""
_SUCC = """succ AS (SELECT month, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS success_rate, count(*) AS n_runs
              FROM agent_runs GROUP BY month)"""
_NRR = """present AS (SELECT month, lead(month) OVER (ORDER BY month) AS next_month FROM (SELECT DISTINCT month FROM paid)),
ratios AS (SELECT a.month, sum(coalesce(b.revenue_usd, 0))::DOUBLE / sum(a.revenue_usd)::DOUBLE AS r
           FROM paid a JOIN present p ON p.month = a.month AND next_month IS NOT NULL
           LEFT JOIN paid b ON b.customer_id = a.customer_id AND b.month = p.next_month
           WHERE a.revenue_usd > 0 GROUP BY a.month)"""
_ACT = """act AS (SELECT c.customer_id, is_sales_led, first_paid_date, status, acquisition_channel,
                   coalesce(s.share >= 0.6::DOUBLE, false) AS activated,
                   first_paid_date IS NOT NULL AND is_sales_led = 0 AS self_serve_converted, status = 'active' AS retained
            FROM customers c LEFT JOIN (SELECT customer_id, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS share
                                        FROM first_runs GROUP BY 1) s USING (customer_id))"""
_ANY = """sized AS (SELECT date_trunc('month', signup_date)::DATE AS cohort_month, count(DISTINCT customer_id) AS cohort_size
               FROM customers JOIN customer_months USING (customer_id) GROUP BY 1),
anyret AS (SELECT cohort_month, date_diff('month', cohort_month, month) AS months_since_signup,
                  count(DISTINCT customer_id) AS active
           FROM (SELECT customer_id, date_trunc('month', signup_date)::DATE AS cohort_month FROM customers)
           JOIN customer_months USING (customer_id) GROUP BY ALL)"""
_DEC = """perc AS (SELECT customer_id, sum(revenue_usd)::DOUBLE AS revenue, sum(llm_cost_usd)::DOUBLE AS llm_cost,
                     (sum(revenue_usd)::DOUBLE - sum(llm_cost_usd)::DOUBLE) / sum(revenue_usd)::DOUBLE AS gross_margin
              FROM cost_months WHERE plan <> 'Free' GROUP BY 1 HAVING sum(revenue_usd) > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY gross_margin, customer_id) AS r, count(*) OVER () AS n FROM perc),
dec AS (SELECT customer_id, revenue, llm_cost, gross_margin, CAST(greatest(1, (10 * (r - 1) + n - 2) // (n - 1)) AS INTEGER) AS decile
        FROM ranked)"""
_AB30 = AB.replace("first_paid_date - assigned_at <= 30", "first_paid_date - assigned_at BETWEEN 0 AND 30")
_SIMPLE = "('test_generation', 'bug_fix', 'refactor', 'dependency_upgrade')"
_FRONT = f"""front AS (SELECT task_type, model, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS success_rate,
                     sum(llm_cost_usd)::DOUBLE / count(*) AS avg_cost, count(*) AS n_runs FROM agent_runs
              WHERE task_type IN {_SIMPLE} AND model IN ('frontier-large', 'balanced-medium') GROUP BY ALL)"""


def _wilson(k: str, n: str, z: str) -> tuple[str, str]:
    p = f"({k}::DOUBLE / {n})"
    z2 = f"({z} * {z})"
    spread = f"{z} * sqrt(({p} * (1 - {p}) + {z2} / (4.0::DOUBLE * {n})) / {n})"
    centre = f"({p} + {z2} / (2.0::DOUBLE * {n}))"
    scale = f"(1 + {z2} / {n})"
    return f"greatest(0.0::DOUBLE, ({centre} - {spread}) / {scale})", f"least(1.0::DOUBLE, ({centre} + {spread}) / {scale})"


_Z95 = "1.9599639845400536::DOUBLE"
_C_LO, _C_HI = _wilson("x1", "n1", _Z95)
_T_LO, _T_HI = _wilson("x2", "n2", _Z95)

FILTERED = {
    "d02_monthly_financials": with_mapping("SELECT * REPLACE (CAST(month AS VARCHAR) AS month) FROM fin", _FIN),
    "d03_run_success_rate": with_mapping("SELECT * REPLACE (CAST(month AS VARCHAR) AS month) FROM succ", _SUCC),
    "d04_nrr_average": with_mapping("SELECT avg(r) AS nrr FROM ratios", _NRR),
    "d05_cohort_retention_any": with_mapping(
        """SELECT CAST(cohort_month AS VARCHAR) AS cohort_month, CAST(months_since_signup AS INTEGER) AS months_since_signup,
                  active, cohort_size, active::DOUBLE / cohort_size AS retention FROM anyret JOIN sized USING (cohort_month)""",
        _ANY,
    ),
    "d06_activation_by_customer": with_mapping(
        "SELECT * REPLACE (CAST(first_paid_date AS VARCHAR) AS first_paid_date) FROM act", _ACT
    ),
    "d07_channel_summary": with_mapping(
        """SELECT acquisition_channel, count(*) AS n_customers, count(*) FILTER (self_serve_converted)::DOUBLE / count(*) AS conversion_rate,
                  count(*) FILTER (retained)::DOUBLE / count(*) AS retention_rate,
                  count(*) FILTER (activated)::DOUBLE / count(*) AS activation_rate
           FROM act WHERE is_sales_led = 0 GROUP BY 1""",
        _ACT,
    ),
    "d08_model_task_success": with_mapping(
        """SELECT model, task_type, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS success_rate,
                  sum(llm_cost_usd)::DOUBLE / count(*) AS avg_cost, count(*) AS n_runs
           FROM agent_runs JOIN (SELECT customer_id FROM customers) USING (customer_id) GROUP BY ALL"""
    ),
    "d09_cost_per_success": with_mapping(
        """SELECT model, sum(llm_cost_usd)::DOUBLE AS total_cost, count(*) FILTER (status = 'success') AS n_success, count(*) AS n_runs,
                  sum(llm_cost_usd)::DOUBLE / NULLIF(count(*) FILTER (status = 'success'), 0) AS cost_per_success
           FROM agent_runs GROUP BY 1"""
    ),
    "d10_migration_pairs_filtered": with_mapping(
        """SELECT source_stack, target_stack, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS success_rate,
                  sum(llm_cost_usd)::DOUBLE / count(*) AS avg_cost, count(*) AS n_runs
           FROM agent_runs WHERE task_type = 'code_migration' GROUP BY ALL"""
    ),
    "d11_executive_kpis": with_mapping(
        """
SELECT CAST(f.month AS VARCHAR) AS month, f.mrr, f.revenue, f.active_paid_customers, f.gross_margin,
       (f.mrr - p.mrr) / NULLIF(p.mrr, 0) AS mrr_change, (f.revenue - p.revenue) / NULLIF(p.revenue, 0) AS revenue_change,
       (f.active_paid_customers - p.active_paid_customers)::DOUBLE / NULLIF(p.active_paid_customers, 0) AS active_paid_customers_change,
       (f.gross_margin - p.gross_margin) * 100 AS gross_margin_change_pp,
       s.success_rate, (s.success_rate - q.success_rate) * 100 AS success_rate_change_pp, (SELECT avg(r) FROM ratios) AS nrr
FROM (SELECT * FROM fin ORDER BY month DESC LIMIT 1) f, (SELECT * FROM fin ORDER BY month DESC LIMIT 1 OFFSET 1) p,
     (SELECT * FROM succ ORDER BY month DESC LIMIT 1) s, (SELECT * FROM succ ORDER BY month DESC LIMIT 1 OFFSET 1) q""",
        f"{_FIN},\n{_SUCC},\n{_NRR}",
    ),
    "d12_failure_tax": with_mapping(
        """SELECT (sum(llm_cost_usd) FILTER (status <> 'success'))::DOUBLE AS failed_cost, sum(llm_cost_usd)::DOUBLE AS total_cost,
                  (sum(llm_cost_usd) FILTER (status <> 'success'))::DOUBLE / sum(llm_cost_usd)::DOUBLE AS share,
                  count(*) FILTER (status <> 'success') AS n_failed, count(*) AS n_runs FROM agent_runs"""
    ),
    "d13_margin_by_plan_filtered": with_mapping(
        """SELECT plan, sum(revenue_usd)::DOUBLE AS revenue, sum(llm_cost_usd)::DOUBLE AS llm_cost,
                  (sum(revenue_usd)::DOUBLE - sum(llm_cost_usd)::DOUBLE) / NULLIF(sum(revenue_usd)::DOUBLE, 0) AS gross_margin
           FROM cost_months WHERE plan <> 'Free' GROUP BY 1"""
    ),
    "d14_cost_per_credit_by_task": with_mapping(
        """
SELECT *, cost_per_credit > team_revenue_per_credit AS above_team_line
FROM (SELECT task_type, sum(llm_cost_usd)::DOUBLE AS total_cost, CAST(sum(credits_charged) AS BIGINT) AS total_credits, count(*) AS n_runs,
             sum(llm_cost_usd)::DOUBLE / NULLIF(sum(credits_charged), 0)::DOUBLE AS cost_per_credit FROM agent_runs GROUP BY 1),
     (SELECT sum(revenue_usd)::DOUBLE / NULLIF(sum(credits_used), 0)::DOUBLE AS team_revenue_per_credit
      FROM customer_months WHERE plan = 'Team')"""
    ),
    "d14_team_revenue_per_credit": with_mapping(
        """SELECT sum(revenue_usd)::DOUBLE / NULLIF(sum(credits_used), 0)::DOUBLE AS team_revenue_per_credit
           FROM customer_months WHERE plan = 'Team'"""
    ),
    "d15_margin_deciles_filtered": with_mapping("SELECT * FROM dec", _DEC),
    "d15_margin_decile_summary": with_mapping(
        """SELECT decile, avg(gross_margin) AS avg_margin, count(*) AS customers,
                  CAST(count_if(avg(gross_margin) < 0) OVER () AS BIGINT) AS negative_deciles FROM dec GROUP BY decile""",
        _DEC,
    ),
    "d16_experiment_conversion": with_mapping(
        "SELECT variant, count(DISTINCT customer_id) AS n, CAST(sum(converted) AS BIGINT) AS conversions FROM ab GROUP BY 1", _AB30
    ),
    "d17_experiment_readout": with_mapping(
        f"""
SELECT n1 AS n_control, n2 AS n_treatment, p1 AS conversion_control, p2 AS conversion_treatment,
       {_C_LO} AS control_ci_low, {_C_HI} AS control_ci_high, {_T_LO} AS treatment_ci_low, {_T_HI} AS treatment_ci_high,
       z AS z_statistic, greatest(0.0::DOUBLE, 2 * (1 - {phi('abs(z)')})) AS p_value,
       ({_Z95} + 0.8416212335729144::DOUBLE) * spread AS minimum_detectable_effect,
       {phi(f'abs(p1 - p2) / spread - {_Z95}')} AS achieved_power
FROM (SELECT *, coalesce((p1 - p2) / NULLIF(sqrt((x1 + x2)::DOUBLE / (n1 + n2) * (1 - (x1 + x2)::DOUBLE / (n1 + n2)) * (w1 + w2)), 0), 0) AS z,
             sqrt(2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2) / ((n1 + n2)::DOUBLE / 2)) AS spread FROM pp)""",
        _AB30,
    ),
    "d18_simple_task_frontier_stats": with_mapping("SELECT * FROM front", _FRONT),
    "d19_routing_what_if": with_mapping(
        """
SELECT CAST(pct AS INTEGER) AS pct, cost AS current_cost_usd, cost * (1 - pct / 100.0::DOUBLE) + other_cost * (pct / 100.0::DOUBLE) AS new_cost_usd,
       cost - (cost * (1 - pct / 100.0::DOUBLE) + other_cost * (pct / 100.0::DOUBLE)) AS savings_usd,
       ok / n AS current_success_rate, (ok * (1 - pct / 100.0::DOUBLE) + other_ok * (pct / 100.0::DOUBLE)) / n AS new_success_rate
FROM (SELECT sum(f.n_runs)::DOUBLE AS n, sum(f.n_runs * f.avg_cost) AS cost, sum(f.n_runs * f.success_rate) AS ok,
             coalesce(sum(f.n_runs * b.avg_cost), 0) AS other_cost, coalesce(sum(f.n_runs * b.success_rate), 0) AS other_ok
      FROM front f LEFT JOIN front b ON b.task_type = f.task_type AND b.model = 'balanced-medium'
      WHERE f.model = 'frontier-large'), range(0, 101, 5) t(pct)""",
        _FRONT,
    ),
}

_CHOSEN_CUSTOMERS = "region IN ('EUROPE', 'ASIA') AND acquisition_channel IN ('Organic', 'Referral') AND industry IN ('BUILDING', 'MACHINERY', 'FURNITURE')"
_CHOSEN_MONTHS = "month IN (DATE '2025-03-01', DATE '2025-04-01', DATE '2025-06-01')"
#: Which conditions on runs and on billing rows a filtered query honours besides those on customers.
_HONOURED = {
    "d02_monthly_financials": ("true", f"{_CHOSEN_MONTHS} AND plan IN ('Pro', 'Team')"),
    "d03_run_success_rate": (f"{_CHOSEN_MONTHS} AND plan_at_run IN ('Pro', 'Team')", "true"),
    "d04_nrr_average": ("true", _CHOSEN_MONTHS),
    "d05_cohort_retention_any": ("true", _CHOSEN_MONTHS),
    "d08_model_task_success": (_CHOSEN_MONTHS, "true"),
    "d11_executive_kpis": (_CHOSEN_MONTHS, _CHOSEN_MONTHS),
}


def _selected(sql: str, runs: str = "true", months: str = "true") -> str:
    """The same query over the chosen customers: the mapping's tables get new names and filtered ones take theirs."""
    for table, follower, condition in (
        ("customers", "experiment_assignments", f"WHERE {_CHOSEN_CUSTOMERS}"),
        ("agent_runs", "run_month", f"SEMI JOIN customers USING (customer_id) WHERE {runs}"),
        ("customer_months", "attempts", f"SEMI JOIN customers USING (customer_id) WHERE {months}"),
    ):
        sql = sql.replace(f"\n{table} AS (", f"\n{table}_all AS (", 1)
        sql = sql.replace(f"\n{follower} AS (", f"\n{table} AS (SELECT * FROM {table}_all {condition}),\n{follower} AS (", 1)
    return sql


FILTERED |= {
    f"{name.removesuffix('_filtered')}_selected": _selected(sql, *_HONOURED.get(name, ()))
    for name, sql in FILTERED.items() if not name.startswith(("d16", "d17"))
}
FILTERED["d01_all_invalid_selection"] = FILTERED["d02_monthly_financials"]

_MIX = f"""pt AS (SELECT plan, task_type, count(*) AS n, sum(llm_cost_usd) AS cost,
                   sum(llm_cost_usd) FILTER (model = 'frontier-large' AND task_type IN {_SIMPLE}) AS fs
            FROM agent_runs a JOIN (SELECT customer_id, month, plan FROM paid) p USING (customer_id, month) GROUP BY ALL),
pm AS (SELECT plan, count(*) AS n_months, sum(revenue_usd)::DOUBLE AS revenue FROM paid GROUP BY 1),
tasks AS (SELECT task_type, sum(credits_charged)::DOUBLE / count(*) AS avg_credits FROM agent_runs GROUP BY 1),
mix AS (SELECT l.plan, t.task_type, coalesce(n, 0)::DOUBLE / coalesce(n_months, 1) AS avg_runs, avg_credits
        FROM (SELECT plan FROM plans WHERE plan <> 'Free') l CROSS JOIN tasks t
        LEFT JOIN pt ON pt.plan = l.plan AND pt.task_type = t.task_type LEFT JOIN pm ON pm.plan = l.plan)"""
_BASE = f"""{_MIX},
{_AB30},
red AS (SELECT 1 - (sum(llm_cost_usd) FILTER (model = 'balanced-medium')::DOUBLE / count(*) FILTER (model = 'balanced-medium'))
                 / (sum(llm_cost_usd) FILTER (model = 'frontier-large')::DOUBLE / count(*) FILTER (model = 'frontier-large')) AS r
        FROM agent_runs WHERE task_type IN {_SIMPLE}),
ela AS (SELECT ((p2 - p1) / NULLIF((p1 + p2) / 2, 0)) / (10::DOUBLE / 34) AS e FROM pp),
base AS (SELECT pl.plan, monthly_fee_usd::DOUBLE AS price, included_credits, overage_usd_per_credit::DOUBLE AS overage_rate,
                coalesce(active, 0) AS active_customers, cost::DOUBLE / n_months AS avg_llm_cost,
                coalesce(fs, 0)::DOUBLE / n_months AS avg_frontier_simple_cost, cu AS credits_used, r AS reduction_factor,
                e AS elasticity, (revenue - cost::DOUBLE) / revenue AS actual_margin
         FROM plans pl
         LEFT JOIN (SELECT current_plan AS plan, count(*) AS active FROM customers WHERE status = 'active' GROUP BY 1) a ON a.plan = pl.plan
         LEFT JOIN pm ON pm.plan = pl.plan
         LEFT JOIN (SELECT plan, sum(cost) AS cost, sum(fs) AS fs FROM pt GROUP BY 1) u ON u.plan = pl.plan
         LEFT JOIN (SELECT plan, sum(avg_runs * avg_credits) AS cu FROM mix GROUP BY 1) c ON c.plan = pl.plan, red, ela
         WHERE pl.plan <> 'Free')"""

WHAT_IF = {
    "x01_workbook_monthly_kpis": with_mapping(
        """
SELECT CAST(month AS VARCHAR) AS month, mrr::DOUBLE AS mrr, rev::DOUBLE AS paid_revenue, cost::DOUBLE AS paid_llm_cost,
       total::DOUBLE AS total_llm_cost, active_customers, paid_customers, (rev::DOUBLE - cost::DOUBLE) / NULLIF(rev::DOUBLE, 0) AS gross_margin
FROM (SELECT month, coalesce(sum(monthly_fee_usd) FILTER (plan <> 'Free'), 0) AS mrr, coalesce(sum(revenue_usd) FILTER (plan <> 'Free'), 0) AS rev,
             coalesce(sum(llm_cost_usd) FILTER (plan <> 'Free'), 0) AS cost, sum(llm_cost_usd) AS total,
             count(DISTINCT customer_id) AS active_customers, count(*) FILTER (plan <> 'Free') AS paid_customers
      FROM cost_months GROUP BY month)"""
    ),
    "x02_workbook_plan_economics": with_mapping(
        """
SELECT plan, count(DISTINCT customer_id) AS customers, count(*) AS customer_months, sum(revenue_usd)::DOUBLE AS revenue,
       sum(llm_cost_usd)::DOUBLE AS llm_cost,
       (sum(revenue_usd)::DOUBLE - sum(llm_cost_usd)::DOUBLE) / NULLIF(sum(revenue_usd)::DOUBLE, 0) AS gross_margin,
       CAST(list_position(['Free', 'Pro', 'Team', 'Enterprise'], plan) AS BIGINT) AS plan_order
FROM cost_months GROUP BY plan"""
    ),
    "x03_workbook_model_task": with_mapping(
        """
SELECT model, task_type, count(*) AS n_runs, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS success_rate,
       sum(llm_cost_usd)::DOUBLE / count(*) AS avg_cost_per_run,
       sum(llm_cost_usd)::DOUBLE / NULLIF(count(*) FILTER (status = 'success'), 0) AS cost_per_success, avg(latency_sec) AS avg_latency_sec
FROM agent_runs GROUP BY ALL"""
    ),
    "x04_customer_summary": with_mapping(
        """
SELECT c.customer_id, company_name, industry, company_size, region, acquisition_channel, current_plan, status,
       CAST(signup_date AS VARCHAR) AS signup_date, CAST(churn_date AS VARCHAR) AS churn_date,
       coalesce(rev, 0)::DOUBLE AS total_revenue, coalesce(n, 0) AS total_runs, coalesce(ok, 0) AS success_rate,
       coalesce(cost, 0)::DOUBLE AS total_llm_cost, coalesce(f, 0) AS first5_success_rate, coalesce(f, 0) >= 0.6::DOUBLE AS activated,
       (rev::DOUBLE - coalesce(cost, 0)::DOUBLE) / NULLIF(rev::DOUBLE, 0) AS gross_margin
FROM customers c
LEFT JOIN (SELECT customer_id, sum(revenue_usd) AS rev FROM customer_months GROUP BY 1) m USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS ok, sum(llm_cost_usd) AS cost
           FROM agent_runs GROUP BY 1) r USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS f FROM first_runs GROUP BY 1) s USING (customer_id)"""
    ),
    "x05_customer_month_flat": with_mapping(
        """
SELECT m.customer_id, CAST(month AS VARCHAR) AS month, plan, monthly_fee_usd::DOUBLE AS monthly_fee_usd, included_credits, credits_used,
       overage_credits, overage_revenue_usd::DOUBLE AS overage_revenue_usd, revenue_usd::DOUBLE AS revenue_usd, llm_cost_usd::DOUBLE AS llm_cost,
       (revenue_usd::DOUBLE - llm_cost_usd::DOUBLE) / NULLIF(revenue_usd::DOUBLE, 0) AS gross_margin, industry, company_size, region, acquisition_channel
FROM cost_months m LEFT JOIN customers c USING (customer_id)"""
    ),
    "x06_simulator_baseline": with_mapping("SELECT * FROM base", _BASE),
    "x06_simulator_task_mix": with_mapping("SELECT * FROM mix", _MIX),
    "x07_pricing_what_if": with_mapping(
        """
SELECT coalesce(plan, 'Total / blended') AS plan, sum(customers) AS customers, CASE WHEN plan IS NOT NULL THEN max(credits_used) END AS credits_used,
       sum(revenue) AS revenue, sum(cost) AS cost, coalesce((sum(revenue) - sum(cost)) / NULLIF(sum(revenue), 0), 0) AS margin,
       coalesce((sum(brev) - sum(bcost)) / NULLIF(sum(brev), 0), 0) AS baseline_margin,
       (coalesce((sum(revenue) - sum(cost)) / NULLIF(sum(revenue), 0), 0) - coalesce((sum(brev) - sum(bcost)) / NULLIF(sum(brev), 0), 0)) * 100 AS delta_pp
FROM (SELECT *, (new_price + extra) * customers AS revenue,
             (avg_llm_cost - avg_frontier_simple_cost * 0.3::DOUBLE * reduction_factor) * customers AS cost,
             (price + extra) * active_customers AS brev, avg_llm_cost * active_customers AS bcost
      FROM (SELECT *, greatest(0, credits_used - included_credits) * overage_rate AS extra,
                   active_customers * (1 + 0.02::DOUBLE) * (1 + elasticity * (new_price - price) / price) AS customers
            FROM (SELECT *, CASE WHEN plan = 'Pro' THEN 35.0::DOUBLE ELSE price END AS new_price FROM base)))
GROUP BY ROLLUP (plan)""",
        _BASE,
    ),
    "x08_scenario_grid": with_mapping(
        """
SELECT scenario, position, total_revenue, total_llm_cost, margin,
       (margin - first_value(margin) OVER (ORDER BY position)) * 100 AS delta_vs_status_quo_pp
FROM (SELECT scenario, position, sum(p * customers) AS total_revenue,
             sum((avg_llm_cost - avg_frontier_simple_cost * routed * reduction_factor) * customers) AS total_llm_cost,
             coalesce((sum(p * customers) - sum((avg_llm_cost - avg_frontier_simple_cost * routed * reduction_factor) * customers))
                      / NULLIF(sum(p * customers), 0), 0) AS margin
      FROM (SELECT *, coalesce(new_price, price) AS p,
                   active_customers * (1 + churn) * (1 + elasticity * (coalesce(new_price, price) - price) / price) AS customers
            FROM base JOIN grid8 USING (plan)) GROUP BY ALL)""",
        _BASE
        + """,
grid8 AS (SELECT scenario, position, plan, new_price::DOUBLE AS new_price, routed::DOUBLE AS routed, churn::DOUBLE AS churn FROM (VALUES
  ('Status Quo', 0, 'Pro', NULL, 0, 0), ('Status Quo', 0, 'Team', NULL, 0, 0), ('Status Quo', 0, 'Enterprise', NULL, 0, 0),
  ('Scenario A', 1, 'Pro', 34, 0.3, 0), ('Scenario A', 1, 'Team', 159, 0.3, 0), ('Scenario A', 1, 'Enterprise', 1200, 0.3, 0),
  ('Scenario B', 2, 'Pro', 29, 0.6, 0.03), ('Scenario B', 2, 'Team', 149, 0.6, 0.03), ('Scenario B', 2, 'Enterprise', 1250, 0.6, 0.03),
  ('Scenario C', 3, 'Pro', 39, 0.6, 0.03), ('Scenario C', 3, 'Team', 179, 0.6, 0.03), ('Scenario C', 3, 'Enterprise', 1350, 0.6, 0.03))
  t(scenario, position, plan, new_price, routed, churn))""",
    ),
}

_DIMS = """dc AS (SELECT CAST(row_number() OVER (ORDER BY customer_id) AS BIGINT) AS customer_key, * FROM customers),
dp AS (SELECT CAST(row_number() OVER (ORDER BY monthly_fee_usd, plan) AS INTEGER) AS plan_key, * FROM plans),
dm AS (SELECT CAST(row_number() OVER (ORDER BY usd_per_m_input DESC, model) AS INTEGER) AS model_key, * FROM models),
dt AS (SELECT CAST(row_number() OVER (ORDER BY task_type) AS INTEGER) AS task_key, task_type,
              CASE WHEN task_type IN ('test_generation', 'bug_fix', 'refactor', 'dependency_upgrade') THEN 1 ELSE 0 END AS is_simple_task
       FROM (SELECT DISTINCT task_type FROM agent_runs))"""


def _safe(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '^[=+\\-@\\t\\r]') THEN '''' || {column} ELSE {column} END AS {column}"


STAR = {
    "s01_dim_customer": with_mapping(
        f"""SELECT customer_key, customer_id, {', '.join(_safe(c) for c in ('company_name', 'industry', 'company_size', 'region',
            'acquisition_channel', 'current_plan', 'status'))}, CAST(signup_date AS VARCHAR) AS signup_date, is_sales_led,
            CAST(first_paid_date AS VARCHAR) AS first_paid_date, CAST(churn_date AS VARCHAR) AS churn_date FROM dc""",
        _DIMS,
    ),
    "s02_dim_plan_usage": with_mapping(
        """SELECT plan_key, plan, monthly_fee_usd::DOUBLE AS monthly_fee_usd, included_credits,
                  overage_usd_per_credit::DOUBLE AS overage_usd_per_credit, n AS customer_months
           FROM dp LEFT JOIN (SELECT plan, count(*) AS n FROM customer_months GROUP BY 1) USING (plan)""",
        _DIMS,
    ),
    "s03_dim_model_usage": with_mapping(
        """SELECT model_key, model, usd_per_m_input::DOUBLE AS usd_per_m_input, usd_per_m_output::DOUBLE AS usd_per_m_output,
                  sec_per_step, n_runs FROM dm LEFT JOIN (SELECT model, count(*) AS n_runs FROM agent_runs GROUP BY 1) USING (model)""",
        _DIMS,
    ),
    "s04_dim_task": with_mapping("SELECT * FROM dt", _DIMS),
    "s05_dim_date": with_mapping(
        """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, strftime(d, '%Y-%m-%d') AS date, CAST(year(d) AS INTEGER) AS year,
       CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
       strftime(date_trunc('month', d), '%Y-%m-%d') AS month_start, CAST(day(d) AS INTEGER) AS day, dayname(d) AS day_of_week,
       CASE WHEN day(d) = 1 THEN 1 ELSE 0 END AS is_month_start
FROM (SELECT unnest(generate_series(date_trunc('month', lo), last_day(hi)::TIMESTAMP, INTERVAL 1 DAY)) AS d
      FROM (SELECT least(min_run, min_month, min_signup, min_churn) AS lo, greatest(max_run, max_month, max_signup, max_churn) AS hi
            FROM (SELECT min(started_at)::DATE AS min_run, max(started_at)::DATE AS max_run FROM agent_runs),
                 (SELECT min(month) AS min_month, max(month) AS max_month FROM customer_months),
                 (SELECT min(signup_date) AS min_signup, max(signup_date) AS max_signup, min(churn_date) AS min_churn,
                         max(churn_date) AS max_churn FROM customers)))"""
    ),
    "s06_fact_agent_runs": with_mapping(
        """
SELECT run_id, customer_key, CAST(strftime(started_at, '%Y%m%d') AS INTEGER) AS date_key, plan_key, model_key, task_key,
       strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, source_stack, target_stack, steps, input_tokens, output_tokens,
       llm_cost_usd::DOUBLE AS llm_cost_usd, latency_sec, lines_changed, tests_total, tests_passed, a.status, credits_charged, human_rating
FROM agent_runs a LEFT JOIN dc ON dc.customer_id = a.customer_id LEFT JOIN dp ON dp.plan = a.plan_at_run
LEFT JOIN dm ON dm.model = a.model LEFT JOIN dt ON dt.task_type = a.task_type""",
        _DIMS,
    ),
    "s07_fact_customer_month": with_mapping(
        """
SELECT customer_key, CAST(strftime(month, '%Y%m%d') AS INTEGER) AS date_key, plan_key, m.monthly_fee_usd::DOUBLE AS monthly_fee_usd,
       m.included_credits, credits_used, overage_credits, overage_revenue_usd::DOUBLE AS overage_revenue_usd,
       revenue_usd::DOUBLE AS revenue_usd, llm_cost_usd::DOUBLE AS llm_cost_usd
FROM cost_months m LEFT JOIN dc ON dc.customer_id = m.customer_id LEFT JOIN dp ON dp.plan = m.plan""",
        _DIMS,
    ),
    "s08_star_monthly_measures": with_mapping(
        """
SELECT CAST(a.month AS VARCHAR) AS month, a.mrr::DOUBLE AS mrr_usd, (a.rev::DOUBLE - a.cost::DOUBLE) / NULLIF(a.rev::DOUBLE, 0) AS gross_margin,
       a.mrr::DOUBLE / NULLIF(b.base::DOUBLE, 0) AS nrr
FROM mm a LEFT JOIN mm b ON b.month = a.month - INTERVAL 12 MONTH""",
        """mm AS (SELECT month, coalesce(sum(monthly_fee_usd) FILTER (plan <> 'Free'), 0) AS mrr,
                   coalesce(sum(revenue_usd) FILTER (plan <> 'Free'), 0) AS rev, coalesce(sum(llm_cost_usd) FILTER (plan <> 'Free'), 0) AS cost,
                   coalesce(sum(monthly_fee_usd) FILTER (plan <> 'Free' AND first_paid_date IS NOT NULL), 0) AS base
            FROM cost_months JOIN customers USING (customer_id) GROUP BY month)""",
    ),
    "s08_star_run_measures": with_mapping(
        """
SELECT count(*) FILTER (status = 'success')::DOUBLE / count(*) AS success_rate,
       sum(llm_cost_usd)::DOUBLE / NULLIF(count(*) FILTER (status = 'success'), 0) AS cost_per_success_usd,
       (SELECT count(*) FILTER (share >= 0.6::DOUBLE)::DOUBLE / count(*)
        FROM (SELECT customer_id, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS share
              FROM (SELECT * FROM agent_runs QUALIFY rank() OVER (PARTITION BY customer_id ORDER BY started_at) <= 5) GROUP BY 1)) AS activation_rate
FROM agent_runs"""
    ),
}

_W_LO, _W_HI = _wilson("n_success", "n_attempts", "1.959963985::DOUBLE")
_WILSON = f"n_success::DOUBLE / n_attempts AS pass_rate, {_W_LO} AS wilson_lo, {_W_HI} AS wilson_hi"


def _pass(k: str) -> str:
    """1 - C(n-c, k) / C(n, k) as the product over i < k."""
    return (
        f"CASE WHEN n - c < least({k}, n) THEN 1.0::DOUBLE ELSE 1 - coalesce(list_product(list_transform(range(least({k}, n)), "
        "lambda i: (n - c - i)::DOUBLE / (n - i))), 1) END"
    )


def _extract_sql(responses: str) -> str:
    return (
        r"""
SELECT response_id, text, regexp_replace(regexp_replace(CASE WHEN len(blocks) > 0 THEN coalesce(list_filter(blocks, lambda b: contains(b, 'def '))[1], blocks[1])
            WHEN line <> '' THEN line ELSE text END, '^\s+', ''), '\s+$', '') AS code, len(blocks) > 0 AS extracted_cleanly
FROM (SELECT *, regexp_extract_all(text, '(?s)```(?:python|python3|py)?\s*\n(.*?)```', 1) AS blocks,
             regexp_extract(replace(text, chr(13) || chr(10), chr(10)), '(?m)^[\t ]*(?:def |import |from )(?s:.*)', 0) AS line FROM """
        + responses
        + ")"
    )


_TASKS = """per AS (SELECT model, task_id, count(*) AS n, count(*) FILTER (status = 'success') AS c FROM attempts GROUP BY ALL)"""

ATTEMPTS = {
    "b01_wilson_ci": with_mapping(
        f"""SELECT model, task_id, n_attempts, n_success, {_WILSON}
            FROM (SELECT model, task_id, count(*) AS n_attempts, count(*) FILTER (status = 'success') AS n_success FROM attempts GROUP BY ALL)"""
    ),
    "b02_pass_at_k": with_mapping(
        f"SELECT model, avg({_pass('3')}) AS pass_at_k, count(*) AS n_tasks, 3 AS k FROM per GROUP BY model", _TASKS
    ),
    "b03_benchmark_by_model": with_mapping(
        f"""
SELECT model, n_attempts, n_success, repeats, pass_at_1, pass_at_repeats, avg_prompt_tokens, avg_output_tokens, avg_latency_sec,
       avg_tokens_per_sec, cost_per_success_usd, total_cost_usd, {_WILSON}
FROM (SELECT model, count(*) AS n_attempts, count(*) FILTER (status = 'success') AS n_success, sum(prompt_tokens)::DOUBLE / count(*) AS avg_prompt_tokens,
             sum(output_tokens)::DOUBLE / count(*) AS avg_output_tokens, avg(total_duration_sec) AS avg_latency_sec,
             avg(tokens_per_sec) AS avg_tokens_per_sec, sum(cost_usd)::DOUBLE / NULLIF(count(*) FILTER (status = 'success'), 0) AS cost_per_success_usd,
             sum(cost_usd)::DOUBLE AS total_cost_usd FROM attempts GROUP BY model)
JOIN (SELECT model, avg({_pass('1')}) AS pass_at_1, avg({_pass('top')}) AS pass_at_repeats, max(top) AS repeats
      FROM per, (SELECT max(n) AS top FROM per) GROUP BY model) USING (model)""",
        _TASKS,
    ),
    "b04_benchmark_by_model_task_type": with_mapping(
        f"""SELECT model, task_type, n_attempts, n_success, avg_tokens_per_sec, avg_cost_usd, {_WILSON}
            FROM (SELECT model, task_type, count(*) AS n_attempts, count(*) FILTER (status = 'success') AS n_success,
                         avg(tokens_per_sec) AS avg_tokens_per_sec, sum(cost_usd)::DOUBLE / count(*) AS avg_cost_usd FROM attempts GROUP BY ALL)"""
    ),
    "b05_contingency": with_mapping(
        """SELECT model, status, count(*) FILTER (hit) AS n
           FROM (SELECT model, coalesce(status, 'unknown') AS status, true AS hit FROM attempts
                 UNION ALL SELECT m.model, s.status, false FROM (SELECT DISTINCT model FROM attempts) m,
                                  (SELECT DISTINCT coalesce(status, 'unknown') AS status FROM attempts) s) GROUP BY ALL"""
    ),
    "b05_outcome_chi2": with_mapping(
        f"""SELECT x2 AS chi2_statistic, CAST(dof AS INTEGER) AS degrees_of_freedom, sqrt(x2 / (n * small)) AS cramers_v,
                   n AS n_observations, {CHI_TAIL} AS p_value FROM chi""",
        chi2_ctes("attempts"),
    ),
    "b06_test_pass_fraction": with_mapping(
        "SELECT model, avg(tests_passed::DOUBLE / NULLIF(tests_total, 0)) AS test_fraction FROM attempts GROUP BY 1"
    ),
    "b07_error_breakdown": with_mapping(
        """SELECT coalesce(error_type, '(no code / no error)') AS error_type, count(*) AS count FROM attempts
           WHERE status <> 'success' GROUP BY 1"""
    ),
    "b08_benchmark_header": with_mapping(
        """SELECT CAST(sum(n) AS BIGINT) AS n_attempts, count(DISTINCT model) AS n_models, count(DISTINCT task_id) AS n_tasks, max(n) AS repeats,
                  bool_or(starts_with(model, 'MOCK/')) AS has_mock_rows FROM per""",
        _TASKS,
    ),
    "b09_price_attempts": with_mapping(
        """
SELECT model, task_type, sum(cost) AS cost_usd, count(*) AS n_attempts
FROM (SELECT a.model, task_type, round(prompt_tokens / 1e6::DOUBLE * usd_per_m_input::DOUBLE + output_tokens / 1e6::DOUBLE * usd_per_m_output::DOUBLE, 8) AS cost
      FROM attempts a JOIN models m ON m.model = a.model) GROUP BY ALL"""
    ),
    "b10_extract_code": with_mapping(_extract_sql("responses")),
    "b10_extract_code_fenced": with_mapping(
        _extract_sql("wrapped"),
        """
wrapped AS (
  SELECT response_id, CASE length(text) % 5
      WHEN 0 THEN concat_ws(chr(10), 'Here it is:', '```python', text, '```', 'Done.')
      WHEN 1 THEN concat_ws(chr(10), '```', text, '```', 'and', '```py', 'def f():', '    return 1', '```')
      WHEN 2 THEN concat_ws(chr(10), '```python3', text)
      WHEN 3 THEN concat_ws(chr(10), 'Sure.', '  import os', text)
      WHEN 4 THEN text END AS text
  FROM responses)""",
    ),
    "b11_grade_status": with_mapping(
        """SELECT status, CASE WHEN tests_total > 0 AND tests_passed = tests_total THEN 'success' WHEN tests_passed > 0 THEN 'partial'
                  ELSE 'failed' END AS graded_status, count(*) AS n FROM attempts GROUP BY ALL"""
    ),
}

def _quality_sql(runs: str, months: str, assigned: str) -> str:
    """Every rule counts what is not proven good, so a missing value is a violation (but for ratings and the revenue sum)."""
    measures = ["llm_cost_usd", "input_tokens", "output_tokens", "steps", "latency_sec", "lines_changed", "credits_charged"]
    billing = ["credits_used", "overage_credits", "overage_revenue_usd", "monthly_fee_usd"]
    all_good = lambda columns: " AND ".join(f"{c} >= 0" for c in columns)
    rows = [
        ("q07_run_measures_non_negative", runs, all_good(measures)),
        ("q08_tests_passed_within_total", runs, "tests_passed >= 0 AND tests_passed <= tests_total"),
        ("q09_rating_between_1_and_5", runs, "human_rating IS NULL OR human_rating BETWEEN 1 AND 5"),
        ("q10_known_status", runs, "status IN ('success', 'partial', 'failed')"),
        ("q11_billing_measures_non_negative", months, all_good(billing)),
        ("q12_revenue_is_fee_plus_overage", months, "coalesce(abs(revenue_usd - monthly_fee_usd - overage_revenue_usd) < 0.000001, true)"),
        ("q13_runs_not_before_signup", f"{runs} JOIN customers c USING (customer_id)", "started_at::DATE >= signup_date"),
        ("q14_runs_not_after_churn", f"{runs} JOIN customers c USING (customer_id)", "(churn_date IS NULL AND started_at IS NOT NULL) OR started_at <= churn_date + INTERVAL 1 DAY"),
        ("q15_free_plan_costs_nothing", months, "plan <> 'Free' OR (monthly_fee_usd = 0 AND overage_revenue_usd = 0)"),
        ("q16_assignments_are_self_serve", f"{assigned} JOIN customers USING (customer_id)", "is_sales_led = 0"),
        ("q17_assigned_within_window", assigned, "assigned_at BETWEEN DATE '2025-02-01' AND DATE '2025-04-30'"),
        ("q18_price_matches_variant", assigned, "pro_price_shown = CASE variant WHEN 'control' THEN 29 WHEN 'treatment' THEN 39 END"),
    ]
    keys = [("q01_customer_id_unique", "customers", "customer_id"), ("q02_run_id_unique", runs, "run_id"), ("q06_one_row_per_customer_month", months, "customer_id, month")]
    parents = [("q03_runs_have_customer", runs), ("q04_months_have_customer", months), ("q05_assignments_have_customer", assigned)]
    return " UNION ALL ".join(
        [f"SELECT '{rule}' AS rule, count(*) AS violations FROM (SELECT 1 FROM {t} GROUP BY {k} HAVING count(*) > 1)" for rule, t, k in keys]
        + [f"SELECT '{rule}', count(*) FROM (SELECT DISTINCT t.customer_id FROM {t} t ANTI JOIN customers c ON c.customer_id = t.customer_id)" for rule, t in parents]
        + [f"SELECT '{rule}', count(*) FILTER (NOT coalesce(({good}), false)) FROM {t}" for rule, t, good in rows]
    )


#: Faulty copies: which rows are spoiled follows from their keys, as in the catalogue.
SOILED = """
bad_runs AS (
  SELECT * EXCLUDE (k) REPLACE (
      CASE WHEN k % 97 = 0 THEN -llm_cost_usd - 1 WHEN k % 101 = 0 THEN NULL ELSE llm_cost_usd END AS llm_cost_usd,
      CASE WHEN k % 103 = 0 THEN tests_total + 1 WHEN k % 107 = 0 THEN NULL ELSE tests_passed END AS tests_passed,
      CASE WHEN k % 109 = 0 THEN 6 ELSE human_rating END AS human_rating,
      CASE WHEN k % 113 = 0 THEN 'lost' WHEN k % 127 = 0 THEN NULL ELSE status END AS status,
      CASE WHEN k % 131 = 0 THEN TIMESTAMP '2000-01-01' WHEN k % 137 = 0 THEN TIMESTAMP '2100-01-01' WHEN k % 139 = 0 THEN NULL ELSE started_at END AS started_at,
      CASE WHEN k % 149 = 0 THEN 'nobody' ELSE customer_id END AS customer_id,
      CASE WHEN k % 151 = 0 THEN 'twice' ELSE run_id END AS run_id)
  FROM (SELECT *, input_tokens AS k FROM agent_runs)),
bad_months AS (
  SELECT * EXCLUDE (k) REPLACE (
      CASE WHEN k % 97 = 0 THEN -1 WHEN k % 101 = 0 THEN NULL ELSE credits_used END AS credits_used,
      CASE WHEN k % 103 = 0 THEN revenue_usd + 1 WHEN k % 107 = 0 THEN NULL ELSE revenue_usd END AS revenue_usd,
      CASE WHEN k % 109 = 0 THEN 'Free' WHEN k % 113 = 0 THEN NULL ELSE plan END AS plan,
      CASE WHEN k % 127 = 0 THEN DATE '2025-01-01' ELSE month END AS month)
  FROM (SELECT *, right(customer_id, 8)::BIGINT AS k FROM customer_months)),
bad_assignments AS (
  SELECT * EXCLUDE (k) REPLACE (
      CASE WHEN k % 7 = 0 THEN DATE '2025-05-01' WHEN k % 11 = 0 THEN NULL ELSE assigned_at END AS assigned_at,
      CASE WHEN k % 13 = 0 THEN 30 WHEN k % 17 = 0 THEN NULL ELSE pro_price_shown END AS pro_price_shown,
      CASE WHEN k % 19 = 0 THEN 'C' || lpad(CAST(k // 10 * 10 AS VARCHAR), 8, '0') ELSE customer_id END AS customer_id)
  FROM (SELECT *, right(customer_id, 8)::BIGINT AS k FROM experiment_assignments))"""

QUALITY = {
    "q01_q18_quality_report": with_mapping(_quality_sql("agent_runs", "customer_months", "experiment_assignments")),
    "q01_q18_soiled_quality_report": with_mapping(_quality_sql("bad_runs", "bad_months", "bad_assignments"), SOILED),
    "q19_star_quality": with_mapping(
        """
SELECT 'q19_dim_plan_key_unique' AS rule, count(*) AS violations FROM (SELECT plan_key FROM dp GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'q19_dim_model_key_unique', count(*) FROM (SELECT model_key FROM dm GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'q19_dim_task_key_unique', count(*) FROM (SELECT task_key FROM dt GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'q19_dim_customer_row_count', abs((SELECT count(*) FROM dc) - (SELECT count(*) FROM customers))
UNION ALL SELECT 'q19_fact_customer_month_row_count', abs(count(*) - (SELECT count(*) FROM customer_months))
   FROM customer_months f JOIN dc ON dc.customer_id = f.customer_id JOIN dp ON dp.plan = f.plan
UNION ALL SELECT 'q19_fact_agent_runs_row_count', abs(count(*) - (SELECT count(*) FROM agent_runs))
   FROM agent_runs f JOIN dc ON dc.customer_id = f.customer_id JOIN dm ON dm.model = f.model JOIN dt ON dt.task_type = f.task_type
UNION ALL SELECT 'q19_dim_customer_key_unique', count(*) FROM (SELECT customer_id FROM dc GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'q19_fact_agent_runs_customer_key_resolves', count(DISTINCT customer_id) FROM agent_runs WHERE customer_id NOT IN (SELECT customer_id FROM dc)
UNION ALL SELECT 'q19_fact_agent_runs_plan_key_resolves', count(DISTINCT plan_at_run) FROM agent_runs WHERE plan_at_run NOT IN (SELECT plan FROM dp)
UNION ALL SELECT 'q19_fact_agent_runs_model_key_resolves', count(DISTINCT model) FROM agent_runs WHERE model NOT IN (SELECT model FROM dm)
UNION ALL SELECT 'q19_fact_agent_runs_task_key_resolves', count(DISTINCT task_type) FROM agent_runs WHERE task_type NOT IN (SELECT task_type FROM dt)
UNION ALL SELECT 'q19_fact_agent_runs_date_key_resolves', count(*) FROM (SELECT DISTINCT started_at::DATE AS d FROM agent_runs) WHERE d > last_day((SELECT max(day) FROM order_days))
UNION ALL SELECT 'q19_fact_customer_month_customer_key_resolves', count(DISTINCT customer_id) FROM customer_months WHERE customer_id NOT IN (SELECT customer_id FROM dc)
UNION ALL SELECT 'q19_fact_customer_month_plan_key_resolves', count(DISTINCT plan) FROM customer_months WHERE plan NOT IN (SELECT plan FROM dp)
UNION ALL SELECT 'q19_fact_customer_month_date_key_resolves', count(DISTINCT month) FROM customer_months WHERE month > (SELECT max(day) FROM order_days)
UNION ALL SELECT 'q19_dim_date_key_unique', count(*) FROM (SELECT strftime(d, '%Y%m%d') FROM calendar GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'q19_dim_date_without_gaps', count(*) FROM (SELECT d - lag(d) OVER (ORDER BY d) AS gap FROM calendar) WHERE gap <> 1""",
        _DIMS
        + """,
calendar AS (SELECT unnest(generate_series(date_trunc('month', low), last_day(high), INTERVAL 1 DAY))::DATE AS d
             FROM (SELECT least((SELECT min(started_at)::DATE FROM agent_runs), (SELECT min(signup_date) FROM customers), (SELECT min(month) FROM customer_months)) AS low,
                          greatest((SELECT max(started_at)::DATE FROM agent_runs), (SELECT max(churn_date) FROM customers), (SELECT max(month) FROM customer_months)) AS high))""",
    ),
    "q20_dataset_summary": with_mapping(
        """
SELECT (SELECT count(*) FROM customers) AS n_customers, (SELECT count(*) FROM customer_months) AS n_customer_months,
       (SELECT count(*) FROM agent_runs) AS n_runs, (SELECT count(*) FROM experiment_assignments) AS n_assignments,
       (SELECT count(*) FILTER (status = 'success')::DOUBLE / count(*) FROM agent_runs) AS success_rate,
       (SELECT (sum(revenue_usd)::DOUBLE - (SELECT sum(llm_cost_usd)::DOUBLE FROM agent_runs)) / sum(revenue_usd)::DOUBLE FROM customer_months) AS gross_margin,
       (SELECT m FROM pm WHERE plan = 'Free') AS gross_margin_free, (SELECT m FROM pm WHERE plan = 'Pro') AS gross_margin_pro,
       (SELECT m FROM pm WHERE plan = 'Team') AS gross_margin_team, (SELECT m FROM pm WHERE plan = 'Enterprise') AS gross_margin_enterprise,
       (SELECT (count(first_paid_date) - count(*) FILTER (is_sales_led = 1))::DOUBLE / count(*) FILTER (is_sales_led = 0) FROM customers) AS conversion_rate,
       (SELECT count(first_paid_date) FILTER (status = 'churned')::DOUBLE FROM customers) / (SELECT count(*) FROM paid) AS paid_churn_rate""",
        """pm AS (SELECT plan, (sum(revenue_usd)::DOUBLE - sum(llm_cost_usd)::DOUBLE) / NULLIF(sum(revenue_usd)::DOUBLE, 0) AS m
            FROM cost_months GROUP BY plan)""",
    ),
}


def _over(sql: str, select: str) -> str:
    """A SELECT over the result of another oracle query."""
    return select.replace("{q}", f"({sql})")


HEADLINE = {
    "m01_headline_growth": _over(
        REPORT_SQL["r01_monthly_kpis"],
        """SELECT l.month, l.mrr_usd, l.mrr_usd * 12 AS arr_usd, b AS lookback_months,
                  (pow(l.mrr_usd / p.mrr_usd, 1.0::DOUBLE / b) - 1) * 100 AS trailing_cmgr_pct, l.mrr_usd - p.mrr_usd AS net_new_mrr_usd,
                  l.active_paid_customers, (SELECT avg(nrr_pct) FROM """
        + f"({REPORT_SQL['r02_nrr_grr']})"
        + """) AS mean_nrr_pct
           FROM (SELECT *, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS n, least(6, count(*) OVER () - 1) AS b FROM {q}) l
           JOIN (SELECT *, row_number() OVER (ORDER BY month) AS i FROM {q}) p ON p.i = l.n - l.b
           WHERE l.i = l.n""",
    ),
    "m02_headline_margins": f"""
SELECT w.plan AS worst_plan, w.gross_margin_pct AS worst_margin_pct, b.plan AS best_plan, b.gross_margin_pct AS best_margin_pct,
       b.gross_margin_pct - w.gross_margin_pct AS margin_gap_pp, p.migration_pair AS worst_migration_pair,
       p.llm_cost_per_credit_usd AS worst_pair_cost_per_credit_usd, t.task_type AS worst_task, t.margin_per_credit_usd AS worst_task_margin_per_credit_usd
FROM (SELECT * FROM ({PRICING_SQL['p01_margin_by_plan']}) ORDER BY gross_margin_pct, plan LIMIT 1) w,
     (SELECT * FROM ({PRICING_SQL['p01_margin_by_plan']}) ORDER BY gross_margin_pct DESC, plan DESC LIMIT 1) b,
     (SELECT * FROM ({REPORT_SQL['r07_migration_pairs']}) ORDER BY llm_cost_per_credit_usd DESC, migration_pair DESC LIMIT 1) p,
     (SELECT * FROM ({REPORT_SQL['r09_task_cost_per_credit']}) ORDER BY margin_per_credit_usd, task_type LIMIT 1) t""",
    "m03_headline_channels": f"""
SELECT b.acquisition_channel AS best_channel, b.self_serve_conversion_pct AS best_conversion_pct,
       w.acquisition_channel AS worst_channel, w.self_serve_conversion_pct AS worst_conversion_pct
FROM (SELECT * FROM ({REPORT_SQL['r05_channel_performance']}) WHERE self_serve_conversion_pct IS NOT NULL
      ORDER BY self_serve_conversion_pct DESC, acquisition_channel DESC LIMIT 1) b,
     (SELECT * FROM ({REPORT_SQL['r05_channel_performance']}) WHERE self_serve_conversion_pct IS NOT NULL
      ORDER BY self_serve_conversion_pct, acquisition_channel LIMIT 1) w""",
    "m04_activation_lift": _over(
        CUSTOMER_SQL["c02_activation_threshold"],
        """SELECT (max(self_serve_conversion_rate) FILTER (min_successes_of_5 = 5)
                   - max(self_serve_conversion_rate) FILTER (min_successes_of_5 = 0)) * 100 AS activation_lift_pp FROM {q}""",
    ),
    "m06_headline_costs": with_mapping(
        """
SELECT coalesce((SELECT sum(cost_delta_per_run_usd * runs_per_month * 12) FROM savings WHERE routing_action = 'route_to_cheaper_model'), 0)
           AS annual_routing_savings_usd,
       coalesce((SELECT -sum(cost_delta_per_run_usd * runs_per_month * 12) FROM savings WHERE routing_action = 'invest_in_reliability'), 0)
           AS annual_reliability_cost_usd,
       (SELECT sum(cost)::DOUBLE FROM failed) AS failed_llm_cost_usd,
       (SELECT sum(cost)::DOUBLE FROM failed) / (SELECT sum(llm_cost_usd)::DOUBLE FROM agent_runs) * 100 AS failed_share_pct,
       f.model AS top_failure_model, f.task_type AS top_failure_task, f.cost::DOUBLE AS top_failure_cost_usd
FROM (SELECT * FROM failed ORDER BY cost DESC, model DESC, task_type DESC LIMIT 1) f""",
        f"""{SAVINGS},
failed AS (SELECT model, task_type, sum(llm_cost_usd) AS cost FROM agent_runs WHERE status = 'failed' GROUP BY ALL)""",
    ),
    "m07_scenario_best": _over(
        PRICING_SQL["p10_pricing_scenarios"],
        """SELECT scenario AS best_scenario, gross_margin_pct AS best_margin_pct, sq AS status_quo_margin_pct, gross_margin_pct - sq AS gain_pp
           FROM {q}, (SELECT gross_margin_pct AS sq FROM {q} WHERE scenario = 'status_quo')
           ORDER BY gross_margin_pct DESC, scenario DESC LIMIT 1""",
    ),
    "m08_retention_matrix": _over(
        REPORT_SQL["r03_cohort_retention"],
        """WITH q AS {q} SELECT c.cohort_month, k.months_since_signup, (SELECT max(retention_pct) FROM q WHERE q.cohort_month = c.cohort_month
                  AND q.months_since_signup = k.months_since_signup) AS retention_pct
           FROM (SELECT DISTINCT cohort_month FROM q) c, (SELECT DISTINCT months_since_signup FROM q) k""",
    ),
    "m08_month_6_average": _over(
        REPORT_SQL["r03_cohort_retention"],
        "SELECT 6 AS months_since_signup, avg(retention_pct) AS mean_retention, count(*) AS cohorts FROM {q} WHERE months_since_signup = 6",
    ),
    "m08_month_3_average": _over(
        FILTERED["d05_cohort_retention_any"],
        "SELECT 3 AS months_since_signup, avg(retention) AS mean_retention, count(*) AS cohorts FROM {q} WHERE months_since_signup = 3",
    ),
    "m09_model_task_matrix_wide": _over(
        REPORT_SQL["r06_model_task_matrix"],
        """WITH q AS {q}, s AS (SELECT task_type, max(success_pct) - min(success_pct) AS spread_pp FROM q GROUP BY 1)
           SELECT task_type, model, success_pct, spread_pp, spread_pp = (SELECT max(spread_pp) FROM s) AS is_widest
           FROM (SELECT * FROM (SELECT DISTINCT task_type FROM q), (SELECT DISTINCT model FROM q))
           LEFT JOIN q USING (task_type, model) JOIN s USING (task_type)""",
    ),
    "m10_km_steps": with_mapping(
        """SELECT "group", 0::BIGINT AS t, 1.0::DOUBLE AS survival FROM km GROUP BY 1
           UNION ALL SELECT "group", t, survival FROM km""",
        KM_ACTIVATION,
    ),
    "m10_km_gap": with_mapping(
        "SELECT 6 AS t, CASE WHEN count(*) = 2 THEN (max(survival) - min(survival)) * 100 END AS gap_pp FROM km WHERE t = 6",
        KM_ACTIVATION,
    ),
    "m12_arm_wald_ci": with_mapping(
        """SELECT 'control' AS variant, n1 AS n, p1 * 100 AS conversion_pct, sqrt(p1 * (1 - p1) / n1) * 100 * 1.96::DOUBLE AS half_width_pp FROM pp
           UNION ALL SELECT 'treatment', n2, p2 * 100, sqrt(p2 * (1 - p2) / n2) * 100 * 1.96::DOUBLE FROM pp""",
        AB,
    ),
    "m13_outcome_by_activation": with_mapping(
        """SELECT activated, count(*) FILTER (self_serve_converted)::DOUBLE / count(*) AS conversion_rate,
                  count(*) FILTER (retained)::DOUBLE / count(*) AS retention_rate, count(*) AS n FROM act GROUP BY 1""",
        _ACT,
    ),
    "m14_format_p": with_mapping(
        f"""SELECT CAST(dof AS INTEGER) AS degrees_of_freedom, n AS n_observations,
                   CASE WHEN {CHI_TAIL} < 0.001 THEN 'p<0.001' ELSE 'p=' || format('{{:.3f}}', {CHI_TAIL}) END AS p_label FROM chi""",
        chi2_ctes("agent_runs"),
    ),
}

_OPTION_SOURCES = {
    "months": ("customer_months", "month"),
    "plans": ("plans", "plan"),
    "regions": ("customers", "region"),
    "channels": ("customers", "acquisition_channel"),
    "industries": ("customers", "industry"),
    "models": ("models", "model"),
    "task_types": ("agent_runs", "task_type"),
}
_STAR_TABLES = {
    "dim_customer": STAR["s01_dim_customer"],
    "dim_plan": with_mapping("SELECT * FROM plans"),
    "dim_model": with_mapping("SELECT * FROM models"),
    "dim_task": STAR["s04_dim_task"],
    "dim_date": STAR["s05_dim_date"],
    "fact_agent_runs": with_mapping("SELECT run_id FROM agent_runs"),
    "fact_customer_month": with_mapping("SELECT month FROM customer_months"),
}

def _digest(name: str, sql: str) -> str:
    """Per column of a query: values, their sum, and the length of what is not a number."""
    return f"""SELECT '{name}' AS table_name, name, count(*) AS n_values, sum(try_cast(value AS DOUBLE)) AS total,
                      sum(CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN length(value) END)::BIGINT AS text_length
               FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM ({sql})) ON COLUMNS(*) INTO NAME name VALUE value) GROUP BY name"""


SOURCES = {
    "io1_table_sizes": with_mapping(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
            for t in ("plans", "models", "customers", "customer_months", "agent_runs", "experiment_assignments")
        )
    ),
    "io1_loaded_tables": with_mapping(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n_rows, {'sum(llm_cost_usd)::DOUBLE' if t == 'agent_runs' else 'NULL::DOUBLE'} AS total_llm_cost_usd FROM {t}"
            for t in ("plans", "models", "customers", "customer_months", "agent_runs", "experiment_assignments")
        )
    ),
    "io2_benchmark_results": with_mapping(
        _digest("attempts", "SELECT *, true AS code_extracted FROM attempts"),
    ),
    "io4_report_files": " UNION ALL ".join(f"({_digest(name, sql)})" for name, sql in REPORT_SQL.items()),
    "io5_star_files": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS n_rows FROM ({sql})" for table, sql in _STAR_TABLES.items()
    ),
    "io6_sanitize_text": f"SELECT doc_id, {_safe('text')}, {_safe('lang')}, {_safe('source')} FROM documents",
    "io7_filter_options": with_mapping(
        " UNION ALL ".join(
            f"SELECT DISTINCT '{f}' AS field, CAST({c} AS VARCHAR) AS value FROM {t}" for f, (t, c) in _OPTION_SOURCES.items()
        )
    ),
}
