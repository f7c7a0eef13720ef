"""DuckDB SQL for R01-R12. Months are ISO text and sums are doubles, as in the catalogue output."""

from usagelens.plans.mapping_sql import with_mapping

REPORTS = {
    "r01_monthly_kpis": with_mapping(
        """
SELECT CAST(now.month AS VARCHAR) AS month, now.fee::DOUBLE AS mrr_usd, now.rev::DOUBLE AS revenue_usd,
       now.payers AS active_paid_customers, now.fee::DOUBLE / NULLIF(now.payers, 0) AS arpa_usd,
       now.joined AS new_logos, now.gone AS churned_logos,
       (now.fee - past.fee)::DOUBLE * 100.0 / NULLIF(past.fee, 0)::DOUBLE AS mrr_mom_growth_pct,
       (now.payers - past.payers)::DOUBLE * 100.0 / NULLIF(past.payers, 0)::DOUBLE AS active_customers_mom_growth_pct
FROM per_month now LEFT JOIN per_month past ON past.place = now.place - 1""",
        """changes AS (
  SELECT month, customer_id AS payer, monthly_fee_usd AS fee, revenue_usd AS rev, 0 AS joined, 0 AS gone FROM paid
  UNION ALL SELECT date_trunc('month', first_paid_date)::DATE, NULL, 0, 0, 1, 0 FROM customers WHERE first_paid_date IS NOT NULL
  UNION ALL SELECT date_trunc('month', churn_date)::DATE, NULL, 0, 0, 0, 1 FROM customers
            WHERE first_paid_date IS NOT NULL AND churn_date IS NOT NULL),
per_month AS (
  SELECT month, dense_rank() OVER (ORDER BY month) AS place, sum(fee) AS fee, sum(rev) AS rev, count(DISTINCT payer) AS payers,
         CAST(sum(joined) AS BIGINT) AS joined, CAST(sum(gone) AS BIGINT) AS gone
  FROM changes GROUP BY month HAVING count(payer) > 0)""",
    ),
    "r02_nrr_grr": with_mapping(
        """
SELECT CAST(target AS VARCHAR) AS month, count(*) AS cohort_customers,
       sum(base)::DOUBLE AS base_revenue_usd, sum(kept)::DOUBLE AS retained_revenue_usd,
       sum(least(base, kept))::DOUBLE AS grr_capped_revenue_usd,
       sum(kept)::DOUBLE * 100.0 / NULLIF(sum(base)::DOUBLE, 0) AS nrr_pct,
       sum(least(base, kept))::DOUBLE * 100.0 / NULLIF(sum(base)::DOUBLE, 0) AS grr_pct
FROM moves WHERE target <= (SELECT max(month) FROM customer_months) GROUP BY target""",
        """moves AS (SELECT (a.month + INTERVAL 1 MONTH)::DATE AS target, a.revenue_usd AS base,
                 coalesce(b.revenue_usd, 0) AS kept
          FROM paid a LEFT JOIN paid b ON b.customer_id = a.customer_id AND b.month = a.month + INTERVAL 1 MONTH)""",
    ),
    "r03_cohort_retention": with_mapping(
        """
SELECT CAST(r.cohort_month AS VARCHAR) AS cohort_month, cohort_size, months_since_signup, retained_customers,
       retained_customers * 100.0::DOUBLE / cohort_size AS retention_pct,
       retained_customers * 100.0::DOUBLE / cohort_size
         - lag(retained_customers * 100.0::DOUBLE / cohort_size)
             OVER (PARTITION BY r.cohort_month ORDER BY months_since_signup) AS retention_pct_change_vs_prior_month
FROM r JOIN sizes s ON s.cohort_month = r.cohort_month""",
        """co AS (SELECT customer_id, date_trunc('month', signup_date)::DATE AS cohort_month FROM customers),
sizes AS (SELECT cohort_month, count(*) AS cohort_size FROM co GROUP BY 1),
r AS (SELECT cohort_month, date_diff('month', cohort_month, month) AS months_since_signup, count(*) AS retained_customers
      FROM paid JOIN co USING (customer_id) GROUP BY ALL)""",
    ),
    "r04_activation": with_mapping(
        """
SELECT successes AS successes_out_of_5, customers, conv::DOUBLE / NULLIF(ss::DOUBLE, 0) * 100 AS self_serve_conversion_pct,
       ss AS self_serve_customers, kept * 100.0::DOUBLE / NULLIF(seen, 0) AS retained_6mo_pct_of_paid,
       kept AS retained_6mo_count, seen AS paid_customers_with_6mo_window,
       rank() OVER (ORDER BY conv::DOUBLE / NULLIF(ss::DOUBLE, 0) DESC NULLS LAST) AS conversion_rank
FROM agg""",
        """scored AS (SELECT customer_id, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS successes
                      FROM first_runs GROUP BY 1 HAVING count(*) = 5),
target AS (SELECT customer_id, (date_trunc('month', first_paid_date) + INTERVAL 6 MONTH)::DATE AS t FROM customers
           WHERE first_paid_date IS NOT NULL),
kept AS (SELECT customer_id, CASE WHEN EXISTS (SELECT 1 FROM paid p WHERE p.customer_id = target.customer_id AND p.month = t)
                             THEN 1 ELSE 0 END AS retained
         FROM target WHERE t <= (SELECT max(month) FROM customer_months)),
agg AS (SELECT successes, count(*) AS customers,
               count(*) FILTER (is_sales_led = 0 AND first_paid_date IS NOT NULL) AS conv,
               count(*) FILTER (is_sales_led = 0) AS ss, CAST(sum(retained) AS BIGINT) AS kept, count(retained) AS seen
        FROM scored JOIN customers USING (customer_id) LEFT JOIN kept USING (customer_id) GROUP BY successes)""",
    ),
    "r05_channel_performance": with_mapping(
        """
SELECT channel AS acquisition_channel, people AS signups, selfs AS self_serve_signups, won AS self_serve_conversions,
       payers AS paid_logos, lost AS paid_logos_churned, worth::DOUBLE AS total_lifetime_revenue_usd,
       win_rate AS self_serve_conversion_pct, loss_rate AS paid_logo_churn_pct,
       worth::DOUBLE / people AS avg_lifetime_revenue_per_signup_usd,
       1 + (SELECT count(*) FROM rates o WHERE coalesce(o.win_rate, -1) > coalesce(t.win_rate, -1)) AS conversion_rank,
       1 + (SELECT count(*) FROM rates o WHERE coalesce(o.loss_rate, -1) < coalesce(t.loss_rate, -1)) AS retention_rank
FROM rates t""",
        """people AS (
  SELECT acquisition_channel AS channel, is_sales_led = 0 AS own, first_paid_date IS NOT NULL AS pays, status = 'churned' AS left_us,
         (SELECT sum(revenue_usd) FROM paid p WHERE p.customer_id = c.customer_id) AS paid_in
  FROM customers c),
sums AS (
  SELECT channel, count(*) AS people, count_if(own) AS selfs, count_if(own AND pays) AS won, count_if(pays) AS payers,
         count_if(pays AND left_us) AS lost, coalesce(sum(paid_in), 0) AS worth
  FROM people GROUP BY channel),
rates AS (SELECT *, won * 100.0::DOUBLE / NULLIF(selfs, 0) AS win_rate, lost * 100.0::DOUBLE / NULLIF(payers, 0) AS loss_rate FROM sums)""",
    ),
    "r06_model_task_matrix": with_mapping(
        """
SELECT model, task_type, n AS n_runs, ok AS n_success, half AS n_partial, bad AS n_failed,
       ok * 100.0::DOUBLE / n AS success_pct, half * 100.0::DOUBLE / n AS partial_pct, bad * 100.0::DOUBLE / n AS failed_pct,
       spent / n AS avg_llm_cost_usd, spent AS total_llm_cost_usd, spent / NULLIF(ok, 0) AS cost_per_success_usd,
       tokens.a::DOUBLE / n AS avg_input_tokens, tokens.b::DOUBLE / n AS avg_output_tokens,
       waits[1 + n // 2] AS p50_latency_sec, waits[1 + 9 * n // 10] AS p90_latency_sec
FROM cells""",
        """cells AS (
  SELECT model, task_type, count(*) AS n, count_if(status = 'success') AS ok, count_if(status = 'partial') AS half,
         count_if(status = 'failed') AS bad, sum(llm_cost_usd)::DOUBLE AS spent,
         {'a': sum(input_tokens), 'b': sum(output_tokens)} AS tokens, list_sort(list(latency_sec), 'ASC', 'NULLS LAST') AS waits
  FROM agent_runs GROUP BY model, task_type)""",
    ),
    "r07_migration_pairs": with_mapping(
        """
SELECT migration_pair, n_runs, n_success, n_success * 100.0::DOUBLE / n_runs AS success_pct,
       cost::DOUBLE / n_runs AS avg_llm_cost_usd, cost::DOUBLE AS total_llm_cost_usd, steps::DOUBLE / n_runs AS avg_steps,
       credits::DOUBLE / n_runs AS avg_credits_charged, cost::DOUBLE / NULLIF(credits, 0)::DOUBLE AS llm_cost_per_credit_usd,
       rank() OVER (ORDER BY cost::DOUBLE / NULLIF(credits, 0)::DOUBLE DESC NULLS LAST) AS cost_per_credit_rank,
       n_runs * 100.0::DOUBLE / (sum(n_runs) OVER ())::DOUBLE AS pct_of_migration_volume
FROM (SELECT source_stack || ' -> ' || target_stack AS migration_pair, count(*) AS n_runs,
             count(*) FILTER (status = 'success') AS n_success, sum(llm_cost_usd) AS cost, sum(steps) AS steps,
             sum(credits_charged) AS credits
      FROM agent_runs WHERE task_type = 'code_migration' GROUP BY 1)"""
    ),
    "r08_unit_economics_plan": with_mapping(
        """
SELECT plan, paying_customers, customer_months, rev::DOUBLE AS total_revenue_usd, cost::DOUBLE AS total_llm_cost_usd,
       (rev - cost)::DOUBLE AS gross_profit_usd, (rev - cost)::DOUBLE * 100.0 / NULLIF(rev::DOUBLE, 0) AS gross_margin_pct,
       cost::DOUBLE / NULLIF(credits::DOUBLE, 0) AS llm_cost_per_credit_usd,
       rev::DOUBLE / NULLIF(credits::DOUBLE, 0) AS revenue_per_credit_usd,
       rank() OVER (ORDER BY (rev - cost)::DOUBLE / NULLIF(rev::DOUBLE, 0) ASC NULLS FIRST) AS margin_rank_worst_first
FROM (SELECT plan, count(DISTINCT customer_id) AS paying_customers, count(*) AS customer_months, sum(revenue_usd) AS rev,
             sum(llm_cost_usd) AS cost, sum(credits_used) AS credits
      FROM cost_months WHERE plan <> 'Free' GROUP BY plan)"""
    ),
    "r09_task_cost_per_credit": with_mapping(
        """
SELECT task_type, n_runs, ok * 100.0::DOUBLE / n_runs AS success_pct, credits::DOUBLE / n_runs AS credits_per_task,
       cost::DOUBLE AS total_llm_cost_usd, cost::DOUBLE / NULLIF(credits, 0)::DOUBLE AS llm_cost_per_credit_usd,
       rate AS blended_revenue_per_credit_usd, rate - cost::DOUBLE / NULLIF(credits, 0)::DOUBLE AS margin_per_credit_usd,
       rank() OVER (ORDER BY rate - cost::DOUBLE / NULLIF(credits, 0)::DOUBLE ASC NULLS FIRST)
           AS margin_per_credit_rank_worst_first
FROM (SELECT task_type, count(*) AS n_runs, count(*) FILTER (status = 'success') AS ok, sum(llm_cost_usd) AS cost,
             sum(credits_charged) AS credits FROM agent_runs GROUP BY 1),
     (SELECT sum(revenue_usd)::DOUBLE / NULLIF(sum(credits_used), 0)::DOUBLE AS rate FROM paid)"""
    ),
    "r10_customer_margin_deciles": with_mapping(
        """
SELECT margin_decile, count(*) AS customers, avg(kept::DOUBLE / earned::DOUBLE) * 100 AS avg_margin_pct,
       min(kept::DOUBLE / earned::DOUBLE) * 100 AS min_margin_pct, max(kept::DOUBLE / earned::DOUBLE) * 100 AS max_margin_pct,
       sum(earned)::DOUBLE AS total_revenue_usd, sum(kept)::DOUBLE AS total_gross_profit_usd,
       avg(migrating) * 100 AS avg_migration_share_pct, any_value(favourite) AS most_common_plan
FROM dealt LEFT JOIN tally USING (margin_decile) GROUP BY margin_decile""",
        # bucket sizes by arithmetic: the first n % 10 buckets hold one customer more than n // 10
        """ledger AS (SELECT customer_id, revenue_usd AS earned, 0 AS spent, NULL AS migration FROM paid
           UNION ALL SELECT customer_id, 0, llm_cost_usd, (task_type = 'code_migration')::INT FROM agent_runs),
book AS (SELECT customer_id, sum(earned) AS earned, sum(earned) - sum(spent) AS kept, coalesce(avg(migration), 0) AS migrating
         FROM ledger GROUP BY customer_id),
line AS (SELECT *, row_number() OVER (ORDER BY kept::DOUBLE / earned::DOUBLE, customer_id) - 1 AS ahead, count(*) OVER () AS n
         FROM book WHERE earned > 0),
dealt AS (SELECT *, CAST(1 + CASE WHEN ahead < (n % 10) * (n // 10 + 1) THEN ahead // (n // 10 + 1)
                                  ELSE (ahead - n % 10) // (n // 10) END AS INTEGER) AS margin_decile FROM line),
tally AS (SELECT margin_decile, min({'fewer': -members, 'plan': current_plan}).plan AS favourite
          FROM (SELECT margin_decile, current_plan, count(*) AS members FROM dealt JOIN customers USING (customer_id)
                WHERE current_plan IS NOT NULL GROUP BY ALL) GROUP BY margin_decile)""",
    ),
    "r11_experiment_results": with_mapping(
        """
SELECT variant, pro_price_shown, count(*) AS n_assigned, CAST(sum(converted) AS BIGINT) AS n_converted_30d,
       sum(rev)::DOUBLE AS total_revenue_first_3mo_usd, sum(converted) * 100.0::DOUBLE / count(*) AS conversion_pct,
       sum(rev)::DOUBLE / count(*) AS avg_revenue_per_assigned_first_3mo_usd,
       sum(converted) * 100.0::DOUBLE / (sum(sum(converted)) OVER ())::DOUBLE AS pct_of_all_converters
FROM ab GROUP BY variant, pro_price_shown""",
        """arms AS (SELECT e.*, first_paid_date,
                    CASE WHEN first_paid_date - assigned_at <= 30 THEN 1 ELSE 0 END AS converted
                    FROM experiment_assignments e JOIN customers USING (customer_id)),
ab AS (SELECT a.*, coalesce((SELECT sum(p.revenue_usd) FROM paid p WHERE p.customer_id = a.customer_id AND a.converted = 1
              AND date_diff('month', date_trunc('month', a.first_paid_date)::DATE, p.month) BETWEEN 0 AND 2), 0) AS rev
       FROM arms a)""",
    ),
    "r12_failure_cost": with_mapping(
        """
SELECT model, task_type, n AS n_failed_runs, cost::DOUBLE AS failed_llm_cost_usd, steps::DOUBLE / n AS avg_steps_on_failure,
       cost::DOUBLE * 100.0 / (SELECT sum(llm_cost_usd) FROM agent_runs)::DOUBLE AS pct_of_total_llm_spend,
       rank() OVER (ORDER BY cost DESC) AS failure_cost_rank,
       (sum(cost) OVER (ORDER BY cost DESC, model, task_type ROWS UNBOUNDED PRECEDING))::DOUBLE * 100.0
         / (sum(cost) OVER ())::DOUBLE AS cumulative_pct_of_failed_spend
FROM (SELECT model, task_type, count(*) AS n, sum(llm_cost_usd) AS cost, sum(steps) AS steps
      FROM agent_runs WHERE status = 'failed' GROUP BY ALL)"""
    ),
}
