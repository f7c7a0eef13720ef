"""DuckDB SQL for the customer (C), model (L) and pricing (P) operators."""

from usagelens.plans.mapping_sql import with_mapping

_SCORES = """scores AS (SELECT customer_id, count(*) AS considered, count(*) FILTER (status = 'success') AS ok,
                       count(*) FILTER (status = 'success')::DOUBLE / count(*) AS score FROM first_runs GROUP BY 1)"""

_LAGGED = """lagged AS (SELECT customer_id, (month + INTERVAL 1 MONTH)::DATE AS month, count(*) AS n,
                       count(*) FILTER (status = 'failed')::DOUBLE / count(*) AS fr,
                       count(*) FILTER (task_type = 'code_migration')::DOUBLE / count(*) AS mr
                       FROM agent_runs r GROUP BY customer_id, r.month)"""

PANEL = f"""{_SCORES},
{_LAGGED},
rows AS (SELECT p.customer_id, p.month, p.plan, p.credits_used, c.signup_date, c.acquisition_channel, c.status, c.churn_date,
                row_number() OVER (PARTITION BY p.customer_id ORDER BY p.month) AS row_number,
                count(*) OVER (PARTITION BY p.customer_id) AS n_rows
         FROM paid p LEFT JOIN customers c USING (customer_id)),
panel AS (SELECT r.*, row_number = n_rows AS is_last_row,
                 CASE WHEN row_number = n_rows AND status = 'churned' THEN 1 ELSE 0 END AS churned_event,
                 date_diff('month', date_trunc('month', signup_date)::DATE, r.month) AS tenure_months,
                 coalesce(l.n, 0)::DOUBLE AS prior_month_n_runs, coalesce(l.fr, 0) AS prior_month_failure_rate,
                 coalesce(l.mr, 0) AS prior_month_migration_share, coalesce(s.score, 0) AS activation_score
          FROM rows r LEFT JOIN lagged l ON l.customer_id = r.customer_id AND l.month = r.month
          LEFT JOIN scores s ON s.customer_id = r.customer_id
          WHERE NOT (row_number = n_rows AND status = 'active' AND r.month = (SELECT max(month) FROM paid)))"""

_KM = """counts AS (SELECT arm AS "group", duration AS t, count(*) AS leaving, count(*) FILTER (event = 1) AS events
                    FROM subjects GROUP BY ALL),
risk AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY "group" ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_at_risk
         FROM counts),
km AS (SELECT "group", t, n_at_risk, events,
              list_reduce(list(1 - events::DOUBLE / n_at_risk) OVER (PARTITION BY "group" ORDER BY t ROWS UNBOUNDED PRECEDING),
                          lambda a, b: a * b) AS survival
       FROM risk)"""

KM_ACTIVATION = f"""{PANEL},
subjects AS (SELECT CASE WHEN max(activation_score) >= 0.6::DOUBLE THEN 'Activated (>=3/5)' ELSE 'Not activated (<3/5)' END AS arm,
                    max(n_rows) AS duration, max(churned_event) AS event
             FROM panel GROUP BY customer_id),
{_KM}"""

FEATURES = f"""{_SCORES},
behaviour AS (SELECT customer_id, count(*) AS n_runs, count(*) FILTER (status = 'failed')::DOUBLE / count(*) AS failure_rate,
                     count(*) FILTER (task_type = 'code_migration')::DOUBLE / count(*) AS migration_share,
                     sum(llm_cost_usd)::DOUBLE / count(*) AS avg_llm_cost FROM agent_runs GROUP BY 1),
bill AS (SELECT customer_id, count(*) FILTER (plan <> 'Free') AS paid_months, sum(revenue_usd)::DOUBLE AS revenue
         FROM customer_months GROUP BY 1),
features AS (SELECT c.customer_id, current_plan, n_runs, failure_rate, migration_share, avg_llm_cost, score AS activation_score,
                    coalesce(paid_months, 0) AS paid_months, coalesce(revenue, 0) AS lifetime_revenue_usd,
                    coalesce(n_runs::DOUBLE / NULLIF(paid_months, 0), n_runs) AS avg_monthly_runs,
                    first_paid_date IS NOT NULL AS ever_paid
             FROM customers c JOIN behaviour USING (customer_id) LEFT JOIN scores USING (customer_id)
             LEFT JOIN bill USING (customer_id))"""

MATRIX = f"""{FEATURES},
ever AS (SELECT * FROM features WHERE ever_paid),
q AS (SELECT quantile_cont(avg_monthly_runs, [0.01, 0.99]) AS a, quantile_cont(avg_llm_cost, [0.01, 0.99]) AS b,
             quantile_cont(lifetime_revenue_usd, [0.01, 0.99]) AS c FROM ever),
shaped AS (SELECT ever.*, ln(1 + greatest(least(avg_monthly_runs, a[2]), a[1])) AS amr,
                  ln(1 + greatest(least(avg_llm_cost, b[2]), b[1])) AS alc,
                  ln(1 + greatest(least(lifetime_revenue_usd, c[2]), c[1])) AS rev FROM ever, q),
matrix AS (
  SELECT customer_id, (amr - avg(amr) OVER ()) / stddev_pop(amr) OVER () AS avg_monthly_runs,
         (failure_rate - avg(failure_rate) OVER ()) / stddev_pop(failure_rate) OVER () AS failure_rate,
         (migration_share - avg(migration_share) OVER ()) / stddev_pop(migration_share) OVER () AS migration_share,
         (activation_score - avg(activation_score) OVER ()) / stddev_pop(activation_score) OVER () AS activation_score,
         (alc - avg(alc) OVER ()) / stddev_pop(alc) OVER () AS avg_llm_cost,
         (rev - avg(rev) OVER ()) / stddev_pop(rev) OVER () AS lifetime_revenue_usd
  FROM shaped)"""

CUSTOMERS = {
    "c01_activation_scores": with_mapping("SELECT customer_id, score AS activation_score FROM scores", _SCORES),
    "c02_activation_threshold": with_mapping(
        """
SELECT CAST(k AS BIGINT) AS min_successes_of_5, count(customer_id) AS n_customers_at_or_above,
       count(*) FILTER (is_sales_led = 0 AND first_paid_date IS NOT NULL)::DOUBLE
           / NULLIF(count(*) FILTER (is_sales_led = 0), 0) AS self_serve_conversion_rate,
       sum(retained)::DOUBLE / NULLIF(count(retained), 0) AS retained_6mo_rate
FROM range(6) t(k) LEFT JOIN base ON ok >= k GROUP BY k""",
        f"""{_SCORES},
target AS (SELECT *, (date_trunc('month', first_paid_date) + INTERVAL 6 MONTH)::DATE AS t FROM customers),
base AS (SELECT t.customer_id, ok, is_sales_led, first_paid_date,
                CASE WHEN first_paid_date IS NULL OR t > (SELECT max(month) FROM customer_months) THEN NULL
                     WHEN p.customer_id IS NULL THEN 0 ELSE 1 END AS retained
         FROM target t JOIN scores s ON s.customer_id = t.customer_id AND considered = 5
         LEFT JOIN paid p ON p.customer_id = t.customer_id AND p.month = t.t)""",
    ),
    "c03_lagged_monthly_run_stats": with_mapping(
        """SELECT customer_id, n AS prior_month_n_runs, fr AS prior_month_failure_rate, mr AS prior_month_migration_share,
                  CAST(month AS VARCHAR) AS month FROM lagged""",
        _LAGGED,
    ),
    "c04_survival_panel": with_mapping(
        """
SELECT customer_id, CAST(month AS VARCHAR) AS month, plan, credits_used, CAST(row_number AS INTEGER) AS row_number, n_rows,
       CAST(signup_date AS VARCHAR) AS signup_date, acquisition_channel, status, CAST(churn_date AS VARCHAR) AS churn_date,
       is_last_row, prior_month_n_runs, prior_month_failure_rate, prior_month_migration_share, activation_score, churned_event,
       CAST(tenure_months AS INTEGER) AS tenure_months, CAST(tenure_months * tenure_months AS INTEGER) AS tenure_months_sq,
       ln(1 + prior_month_n_runs) AS log_monthly_runs
FROM panel""",
        PANEL,
    ),
    "c08_kaplan_meier": with_mapping(
        'SELECT "group", CAST(t AS INTEGER) AS t, n_at_risk, events, survival FROM km',
        f"""subjects AS (SELECT acquisition_channel AS arm, status = 'churned' AS churned,
                          CASE WHEN status = 'churned' THEN 1 ELSE 0 END AS event,
                          date_diff('month', date_trunc('month', signup_date)::DATE,
                              coalesce(date_trunc('month', churn_date)::DATE, (SELECT max(month) FROM customer_months))) + 1 AS duration
                   FROM customers),
{_KM}""",
    ),
    "c09_km_by_activation": with_mapping('SELECT "group", t, n_at_risk, events, survival FROM km', KM_ACTIVATION),
    "c10_customer_usage_features": with_mapping("SELECT * FROM features", FEATURES),
    "c11_never_paid_segment": with_mapping(
        """
SELECT 'Never converted (Free only)' AS persona_name, count(*) FILTER (NOT ever_paid) AS n_customers,
       count(*) FILTER (NOT ever_paid)::DOUBLE / NULLIF(count(*), 0) AS share_of_all_customers,
       avg(avg_monthly_runs) FILTER (NOT ever_paid) AS avg_monthly_runs, avg(failure_rate) FILTER (NOT ever_paid) AS failure_rate,
       avg(migration_share) FILTER (NOT ever_paid) AS migration_share,
       avg(activation_score) FILTER (NOT ever_paid) AS activation_score,
       avg(avg_llm_cost) FILTER (NOT ever_paid) AS avg_llm_cost,
       avg(lifetime_revenue_usd) FILTER (NOT ever_paid) AS lifetime_revenue_usd
FROM features""",
        FEATURES,
    ),
    "c12_cluster_matrix": with_mapping("SELECT * FROM matrix", MATRIX),
}

_RATES = """rates AS (SELECT task_type, model, count(*) AS n, count(*) FILTER (status = 'success') AS ok, sum(llm_cost_usd) AS cost,
                      count(*) FILTER (status = 'success')::DOUBLE / count(*) AS rate,
                      sum(llm_cost_usd)::DOUBLE / count(*) AS avg_cost FROM agent_runs GROUP BY ALL)"""

def uniform(key: str) -> str:
    """52 bits of an MD5 digest as a number in (0, 1)."""
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496::DOUBLE"


#: All 2000 draws of every group, each by the inverse distribution function, and their quantiles.
RESAMPLED = f"""sized AS (SELECT task_type, model, n, ok, ok::DOUBLE / n AS rate, CASE WHEN ok IN (0, n) THEN ok ELSE
             greatest(0, floor(ok - 10 * sqrt(ok::DOUBLE * (n - ok) / n)))::BIGINT END AS low,
             CASE WHEN ok IN (0, n) THEN ok ELSE least(n, ceil(ok + 10 * sqrt(ok::DOUBLE * (n - ok) / n) + 20))::BIGINT END AS high
          FROM (SELECT task_type, model, count(*) AS n, count(*) FILTER (status = 'success') AS ok FROM agent_runs GROUP BY ALL)),
heights AS (SELECT *, sum(CASE WHEN k = low THEN 0 ELSE ln((n - k + 1)::DOUBLE / k * ok / (n - ok)) END)
                      OVER (PARTITION BY task_type, model ORDER BY k) AS h
            FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM sized)),
masses AS (SELECT *, exp(h - max(h) OVER (PARTITION BY task_type, model)) AS m FROM heights),
steps AS (SELECT task_type, model, k, coalesce(sum(m) OVER (PARTITION BY task_type, model ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
                 AND 1 PRECEDING), -1) / sum(m) OVER (PARTITION BY task_type, model) AS x FROM masses),
draws AS (SELECT task_type, model, n, {uniform("task_type || '|' || model || '|' || r")} AS x FROM sized, range(1, 2001) t(r)),
intervals AS (SELECT d.task_type, d.model, quantile_cont(s.k::DOUBLE / n, 0.025) AS ci_low, quantile_cont(s.k::DOUBLE / n, 0.975) AS ci_high
              FROM draws d ASOF JOIN steps s ON d.task_type = s.task_type AND d.model = s.model AND d.x > s.x GROUP BY ALL)"""

#: Two-sided tail of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(dof).
STUDENT_TAIL = """(SELECT exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) * 2 / sqrt(pi()) * sum(CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
          * exp((dof - 1) * ln(greatest(cos(f + (e - f) * i / 40000), 1e-300)))) * (e - f) / 120000
   FROM (SELECT atan(abs({t}) / sqrt({dof})) AS f, least(pi() / 2, atan(abs({t}) / sqrt({dof})) + 40 / sqrt({dof})) AS e, {dof} AS dof), range(0, 40001) g(i)
   GROUP BY dof, e, f)"""

_ROUTING = f"""{_RATES},
placed AS (SELECT *, max(rate) OVER (PARTITION BY task_type) AS best,
                  row_number() OVER (PARTITION BY task_type ORDER BY rate DESC, model) AS lead_place FROM rates),
routing AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY rate < best - 0.02::DOUBLE, avg_cost, model) = 1 AS chosen
            FROM placed)"""

SAVINGS = f"""{_ROUTING},
now_mix AS (SELECT task_type, sum(cost)::DOUBLE / sum(n)::DOUBLE AS current_avg_cost_usd, sum(ok)::DOUBLE / sum(n)::DOUBLE AS current_success_rate,
                   CAST(sum(n) AS BIGINT) AS n_runs FROM rates GROUP BY 1),
savings AS (SELECT m.task_type, current_avg_cost_usd, current_success_rate, n_runs, model AS recommended_model,
                   rate AS recommended_success_rate, avg_cost AS recommended_avg_cost_usd,
                   current_avg_cost_usd - avg_cost AS cost_delta_per_run_usd,
                   CASE WHEN current_avg_cost_usd - avg_cost > 0 THEN 'route_to_cheaper_model' ELSE 'invest_in_reliability' END
                       AS routing_action,
                   (rate - current_success_rate) * 100 AS success_rate_delta_pp,
                   n_runs::DOUBLE / (SELECT count(DISTINCT month) FROM agent_runs) AS runs_per_month
            FROM now_mix m JOIN routing r ON r.task_type = m.task_type AND chosen)"""


def chi2_ctes(source: str) -> str:
    return f"""cells AS (SELECT a.model, b.status, (SELECT count(*) FROM {source} x WHERE x.model = a.model AND x.status = b.status) AS o
           FROM (SELECT DISTINCT model FROM {source}) a, (SELECT DISTINCT status FROM {source}) b),
margins AS (SELECT *, sum(o) OVER (PARTITION BY model) AS rt, sum(o) OVER (PARTITION BY status) AS ct, sum(o) OVER () AS n FROM cells),
chi AS (SELECT sum((o - rt::DOUBLE * ct::DOUBLE / n) ** 2 / (rt::DOUBLE * ct::DOUBLE / n)) AS x2,
               (count(DISTINCT model) - 1) * (count(DISTINCT status) - 1) AS dof, CAST(max(n) AS BIGINT) AS n,
               least(count(DISTINCT model), count(DISTINCT status)) - 1 AS small FROM margins)"""


# upper tail for an even number of degrees of freedom: exp(-x/2) * sum of (x/2)^i / i!, i < dof/2
CHI_TAIL = """exp(-x2 / 2) * list_sum(list_transform(range(dof // 2), lambda i: (x2 / 2) ** i / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE)))"""

MODELS = {
    "l01_pooled_success": with_mapping(
        "SELECT model, count(*) FILTER (status = 'success')::DOUBLE / count(*) AS pooled_success_rate FROM agent_runs GROUP BY 1"
    ),
    "l02_stratified_success": with_mapping("SELECT task_type, model, rate AS success_rate, n AS n_runs FROM rates", _RATES),
    "l03_simpsons_reversal": with_mapping(
        """
SELECT a.model AS model_a, b.model AS model_b, CASE WHEN a.pooled > b.pooled THEN a.model ELSE b.model END AS pooled_winner,
       count(*) FILTER ((x.rate > y.rate) = (a.pooled > b.pooled))::DOUBLE / count(y.rate) AS pct_task_strata_agreeing_with_pooled_winner,
       count(*) FILTER ((x.rate > y.rate) = (a.pooled > b.pooled)) = 0 AS reversal_flag
FROM pooled a JOIN pooled b ON a.pooled > b.pooled OR (a.pooled = b.pooled AND a.model < b.model)
JOIN rates x ON x.model = a.model JOIN rates y ON y.model = b.model AND y.task_type = x.task_type
GROUP BY ALL""",
        f"""{_RATES},
pooled AS (SELECT model, sum(ok)::DOUBLE / sum(n)::DOUBLE AS pooled FROM rates GROUP BY 1)""",
    ),
    "l04_chi_square": with_mapping(
        f"""SELECT x2 AS chi2_statistic, CAST(dof AS INTEGER) AS degrees_of_freedom, sqrt(x2 / (n * small)) AS cramers_v,
                   n AS n_observations, {CHI_TAIL} AS p_value FROM chi""",
        chi2_ctes("agent_runs"),
    ),
    "l05_cost_quality_frontier": with_mapping(
        """
SELECT task_type, model, avg_cost AS avg_cost_usd, rate AS success_rate, n AS n_runs,
       NOT EXISTS (SELECT 1 FROM rates o WHERE o.task_type = r.task_type AND o.avg_cost <= r.avg_cost AND o.rate >= r.rate
                   AND (o.avg_cost < r.avg_cost OR o.rate > r.rate)) AS on_pareto_frontier
FROM rates r""",
        _RATES,
    ),
    "l06_bootstrap_rate_ci": with_mapping(
        """SELECT task_type, model, n AS n_runs, ok AS n_success, rate AS success_rate, ci_low AS success_rate_ci_low,
                  ci_high AS success_rate_ci_high FROM sized JOIN intervals USING (task_type, model)""",
        RESAMPLED,
    ),
    "l07_routing_policy": with_mapping(
        """SELECT task_type, model, r.rate AS success_rate, ci_low AS success_rate_ci_low, ci_high AS success_rate_ci_high,
                  avg_cost AS avg_cost_usd, r.n AS n_runs, lead_place = 1 AS is_current_best_success, chosen AS is_recommended
           FROM routing r JOIN intervals USING (task_type, model)""",
        _ROUTING.rstrip().rstrip(",") + ",\n" + RESAMPLED,
    ),
    "l09_rating_status_spearman": with_mapping(
        """SELECT n AS n_rated_runs, rho AS spearman_rho, failed AS mean_rating_failed, partly AS mean_rating_partial,
                  good AS mean_rating_success, """
        + STUDENT_TAIL.format(t="(rho * sqrt((n - 2) / ((1 - rho) * (1 + rho))))", dof="(n - 2)::DOUBLE")
        + """ AS p_value
           FROM (SELECT count(*) AS n, corr(x, y) AS rho, avg(r) FILTER (s = 0) AS failed, avg(r) FILTER (s = 1) AS partly, avg(r) FILTER (s = 2) AS good
                 FROM (SELECT s, r, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS x,
                              rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0::DOUBLE AS y
                       FROM (SELECT human_rating AS r, CASE status WHEN 'failed' THEN 0 WHEN 'partial' THEN 1 WHEN 'success' THEN 2 END AS s
                             FROM agent_runs WHERE human_rating IS NOT NULL) WHERE s IS NOT NULL))"""
    ),
    "l07_routing_rates": with_mapping(
        """SELECT task_type, model, rate AS success_rate, avg_cost AS avg_cost_usd, n AS n_runs, ok AS n_success,
                  lead_place = 1 AS is_current_best_success, chosen AS is_recommended FROM routing""",
        _ROUTING,
    ),
    "l08_routing_savings": with_mapping(
        """SELECT *, cost_delta_per_run_usd * runs_per_month AS monthly_dollar_impact_usd,
                  cost_delta_per_run_usd * runs_per_month * 12 AS annual_dollar_impact_usd FROM savings""",
        SAVINGS,
    ),
}

AB = """ab AS (SELECT e.customer_id, variant, assigned_at, first_paid_date,
               CASE WHEN first_paid_date - assigned_at <= 30 THEN 1 ELSE 0 END AS converted
        FROM experiment_assignments e JOIN customers USING (customer_id)),
arms AS (SELECT count(*) FILTER (variant = 'control') AS n1, count(*) FILTER (variant = 'treatment') AS n2,
                count(*) FILTER (variant = 'control' AND converted = 1) AS x1,
                count(*) FILTER (variant = 'treatment' AND converted = 1) AS x2 FROM ab),
pp AS (SELECT *, x1::DOUBLE / n1 AS p1, x2::DOUBLE / n2 AS p2, 1::DOUBLE / n1 AS w1, 1::DOUBLE / n2 AS w2 FROM arms)"""


def phi(z: str) -> str:
    """Normal CDF of a SQL expression by the same series as the Spark column."""
    bounded = f"greatest(least({z}, 8.0::DOUBLE), -8.0::DOUBLE)"
    terms = (
        "list_sum(list_transform(range(151), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE "
        "list_product(list_transform(range(1, i + 1), lambda j: ({b}) * ({b}) / (2 * j + 1))) END))"
    ).replace("{b}", bounded)
    return f"(0.5::DOUBLE + exp(-({bounded}) * ({bounded}) / 2) / sqrt(2 * pi()) * ({bounded}) * {terms})"


DECILED = """rc AS (SELECT customer_id, sum(llm_cost_usd) AS cost FROM agent_runs GROUP BY 1),
econ AS (SELECT customer_id, sum(revenue_usd) AS rev FROM paid GROUP BY 1 HAVING sum(revenue_usd) > 0),
mm AS (SELECT customer_id, rev, (rev - coalesce(cost, 0))::DOUBLE / rev::DOUBLE AS margin FROM econ LEFT JOIN rc USING (customer_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY margin, customer_id) AS r, count(*) OVER () AS n FROM mm),
dec AS (SELECT *, CAST(greatest(1, (10 * (r - 1) + n - 2) // (n - 1)) AS INTEGER) AS decile FROM ranked)"""

PRICING = {
    "p01_margin_by_plan": with_mapping(
        """SELECT plan, sum(revenue_usd)::DOUBLE AS total_revenue_usd, sum(llm_cost_usd)::DOUBLE AS total_llm_cost_usd,
                  (sum(revenue_usd)::DOUBLE - sum(llm_cost_usd)::DOUBLE) / NULLIF(sum(revenue_usd)::DOUBLE, 0) * 100 AS gross_margin_pct
           FROM cost_months WHERE plan <> 'Free' GROUP BY 1"""
    ),
    "p02_margin_by_task": with_mapping(
        """
SELECT task_type, cost::DOUBLE AS total_llm_cost_usd, credits AS total_credits, credits * rate AS implied_revenue_usd,
       (credits * rate - cost::DOUBLE) / NULLIF(credits * rate, 0) * 100 AS margin_pct
FROM (SELECT task_type, sum(llm_cost_usd) AS cost, CAST(sum(credits_charged) AS BIGINT) AS credits FROM agent_runs GROUP BY 1),
     (SELECT sum(revenue_usd)::DOUBLE / NULLIF(sum(credits_used), 0)::DOUBLE AS rate FROM paid)"""
    ),
    "p03_margin_by_decile": with_mapping(
        """SELECT decile, count(*) AS customers, avg(margin) * 100.0 AS avg_margin_pct, sum(rev)::DOUBLE AS total_revenue_usd
           FROM dec GROUP BY 1""",
        DECILED,
    ),
    "p04_experiment_frame": with_mapping(
        """
SELECT a.customer_id, variant, CAST(assigned_at AS VARCHAR) AS assigned_at, CAST(first_paid_date AS VARCHAR) AS first_paid_date,
       converted, coalesce(rev, 0)::DOUBLE AS revenue_first_3mo_usd
FROM ab a LEFT JOIN (SELECT a.customer_id, sum(revenue_usd) AS rev FROM ab a JOIN paid p ON p.customer_id = a.customer_id
     WHERE converted = 1 AND p.month >= date_trunc('month', first_paid_date)
       AND p.month < date_trunc('month', first_paid_date) + INTERVAL 3 MONTH GROUP BY 1) f ON f.customer_id = a.customer_id""",
        AB,
    ),
    "p05_two_proportion_z": with_mapping(
        f"""
SELECT n1 AS n_control, n2 AS n_treatment, p1 AS conversion_control, p2 AS conversion_treatment,
       p1 - p2 AS diff_control_minus_treatment,
       p1 - p2 - 1.96::DOUBLE * sqrt(p1 * (1 - p1) * w1 + p2 * (1 - p2) * w2) AS diff_ci_low,
       p1 - p2 + 1.96::DOUBLE * sqrt(p1 * (1 - p1) * w1 + p2 * (1 - p2) * w2) AS diff_ci_high,
       z AS z_statistic, greatest(0.0::DOUBLE, 2 * (1 - {phi('abs(z)')})) AS p_value
FROM (SELECT *, (p1 - p2) / NULLIF(sqrt((x1 + x2)::DOUBLE / (n1 + n2) * (1 - (x1 + x2)::DOUBLE / (n1 + n2)) * (w1 + w2)), 0) AS z FROM pp)""",
        AB,
    ),
    "p06_bootstrap_revenue_ci": with_mapping(
        """SELECT m.metric, m.mean, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high
           FROM means m JOIN (UNPIVOT (SELECT control AS control_revenue_per_assigned, treatment AS treatment_revenue_per_assigned,
                                              treatment - control AS diff_treatment_minus_control FROM resampled)
                              ON control_revenue_per_assigned, treatment_revenue_per_assigned, diff_treatment_minus_control
                              INTO NAME metric VALUE v) u ON u.metric = m.metric
           GROUP BY ALL""",
        AB
        + f""",
earned AS (SELECT variant, coalesce(rev, 0) AS revenue
           FROM ab a LEFT JOIN (SELECT a.customer_id, sum(revenue_usd) AS rev FROM ab a JOIN paid p ON p.customer_id = a.customer_id
                WHERE converted = 1 AND p.month >= date_trunc('month', first_paid_date)
                  AND p.month < date_trunc('month', first_paid_date) + INTERVAL 3 MONTH GROUP BY 1) f ON f.customer_id = a.customer_id),
means AS (SELECT CASE variant WHEN 'control' THEN 'control_revenue_per_assigned' ELSE 'treatment_revenue_per_assigned' END AS metric,
                 sum(revenue)::DOUBLE / count(*) AS mean FROM earned GROUP BY variant
          UNION ALL SELECT 'diff_treatment_minus_control', sum(revenue) FILTER (variant = 'treatment')::DOUBLE / count(*) FILTER (variant = 'treatment')
                 - sum(revenue) FILTER (variant = 'control')::DOUBLE / count(*) FILTER (variant = 'control') FROM earned),
prices AS (SELECT variant, round(revenue * 100)::BIGINT AS cents, count(*) AS c FROM earned GROUP BY ALL),
heights AS (SELECT *, sum(CASE WHEN k = low THEN 0 ELSE ln(c::DOUBLE / k) END) OVER (PARTITION BY variant, cents ORDER BY k) AS h
            FROM (SELECT *, greatest(0, floor(c - 10 * sqrt(c)))::BIGINT AS low,
                         unnest(range(greatest(0, floor(c - 10 * sqrt(c)))::BIGINT, ceil(c + 10 * sqrt(c) + 20)::BIGINT + 1)) AS k FROM prices)),
masses AS (SELECT *, exp(h - max(h) OVER (PARTITION BY variant, cents)) AS m FROM heights),
steps AS (SELECT variant, cents, k, coalesce(sum(m) OVER (PARTITION BY variant, cents ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
                 AND 1 PRECEDING), -1) / sum(m) OVER (PARTITION BY variant, cents) AS x FROM masses),
weights AS (SELECT d.variant, d.cents, d.r, s.k AS w
            FROM (SELECT variant, cents, r, {uniform("variant || '|' || cents || '|' || r")} AS x FROM prices, range(1, 5001) t(r)) d
            ASOF JOIN steps s ON d.variant = s.variant AND d.cents = s.cents AND d.x > s.x),
resampled AS (SELECT r, sum(w * cents) FILTER (variant = 'control')::DOUBLE / (sum(w) FILTER (variant = 'control') * 100) AS control,
                     sum(w * cents) FILTER (variant = 'treatment')::DOUBLE / (sum(w) FILTER (variant = 'treatment') * 100) AS treatment
              FROM weights GROUP BY r)""",
    ),
    "p07_power_and_mde": with_mapping(
        f"""
SELECT n1 AS n_control, n2 AS n_treatment, p1 AS conversion_control, p2 AS conversion_treatment, h AS observed_effect_size_h,
       {phi('abs(h) * root - za')} + {phi('-abs(h) * root - za')} AS achieved_power,
       abs(sin(asin(sqrt(greatest(least(p1, 1 - 1e-6), 1e-6))) + (za + zb) / root / 2) ** 2 - p1) * 100 AS mde_at_80pct_power_pp,
       2 * ((za + zb) * (za + zb) / NULLIF(h * h, 0)) AS required_n_per_arm_for_observed_effect_at_80pct_power
FROM (SELECT *, 2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)) AS h, sqrt(1::DOUBLE / (w1 + w2)) AS root,
             1.9599639845400536::DOUBLE AS za, 0.8416212335729144::DOUBLE AS zb FROM pp)""",
        AB,
    ),
    "p08_effect_size_to_p2": with_mapping(
        """
SELECT n1 AS n_control, n2 AS n_treatment,
       sin(asin(sqrt(greatest(least(p1, 1 - 1e-6), 1e-6))) + (2 * asin(sqrt(p2)) - 2 * asin(sqrt(p1))) / 2) ** 2 AS p2_recovered
FROM pp""",
        AB,
    ),
    "p09_arc_elasticity": with_mapping(
        """
SELECT 29::DOUBLE AS price_control, 39::DOUBLE AS price_treatment, p1 AS conversion_control, p2 AS conversion_treatment,
       ((p2 - p1) / NULLIF((p1 + p2) / 2, 0)) / (10::DOUBLE / 34) AS arc_price_elasticity_of_conversion
FROM pp""",
        AB,
    ),
    "p10_pricing_scenarios": with_mapping(
        """
SELECT scenario, assumption, revenue AS total_revenue_usd, cost AS total_llm_cost_usd, revenue - cost AS gross_profit_usd,
       (revenue - cost) * 100 / NULLIF(revenue, 0) AS gross_margin_pct
FROM (SELECT unnest([{'scenario': 'status_quo', 'assumption': 'Billing and run cost as observed.', 'revenue': rev, 'cost': cost},
                     {'scenario': 'complexity_weighted_migration_credits',
                      'assumption': 'A migration run is charged 10 credits instead of 6, sold at the mean revenue per credit; run cost stays.', 'revenue': rev + migrations * 4 * (rev / credits), 'cost': cost},
                     {'scenario': 'route_simple_tasks_to_balanced_medium',
                      'assumption': 'Runs of bug_fix, dependency_upgrade, test_generation cost what balanced-medium costs per run of the task; revenue stays.',
                      'revenue': rev, 'cost': other + rerouted},
                     {'scenario': 'pro_39',
                      'assumption': 'The fee rises by 10 USD in all Pro months and nobody leaves because of it: an upper bound.', 'revenue': rev + pro * 10, 'cost': cost}], recursive := true)
      FROM bill, usage)""",
        """bill AS (SELECT sum(revenue_usd)::DOUBLE AS rev, sum(credits_used)::DOUBLE AS credits, count(*) FILTER (plan = 'Pro') AS pro FROM paid),
per AS (SELECT task_type, count(*) AS n, sum(llm_cost_usd) AS cost,
               sum(llm_cost_usd) FILTER (model = 'balanced-medium')::DOUBLE / count(*) FILTER (model = 'balanced-medium') AS balanced,
               task_type IN ('test_generation', 'bug_fix', 'dependency_upgrade') AS simple
        FROM agent_runs GROUP BY 1),
usage AS (SELECT sum(cost)::DOUBLE AS cost, (sum(cost) FILTER (NOT simple))::DOUBLE AS other, sum(n * balanced) FILTER (simple) AS rerouted,
                 (sum(n) FILTER (task_type = 'code_migration'))::DOUBLE AS migrations FROM per)""",
    ),
}
