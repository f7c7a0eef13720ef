"""The same mapping as DuckDB CTEs; the oracle queries are written against these names."""

MAPPING = """
order_days AS (
  SELECT o_orderkey, o_custkey AS custkey,
         DATE '2025-01-01' + CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 4.0) AS INTEGER) AS day
  FROM orders),
newest AS (SELECT CAST(date_trunc('month', max(day)) AS DATE) AS max_month FROM order_days),
spans AS (
  SELECT custkey, min(day) AS signup_date,
         CAST(date_trunc('month', min(day)) AS DATE) AS signup_month,
         CAST(date_trunc('month', max(day)) AS DATE) AS last_month
  FROM order_days GROUP BY custkey),
ends AS (
  SELECT s.*, last_month < max_month - INTERVAL 2 MONTH AS churned,
         CASE WHEN last_month < max_month - INTERVAL 2 MONTH THEN last_month ELSE max_month END AS end_month,
         CASE WHEN custkey % 10 = 0 THEN signup_date
              WHEN custkey % 3 <> 0 THEN CAST(signup_month + to_months(CAST(custkey % 3 AS INTEGER)) AS DATE)
         END AS entry_date
  FROM spans s, newest),
lifecycles AS (
  SELECT custkey, signup_date, signup_month, churned, end_month,
         CASE WHEN custkey % 10 = 0 THEN 1 ELSE 0 END AS is_sales_led,
         CASE WHEN entry_date <= last_day(end_month) THEN entry_date END AS first_paid_date
  FROM ends),
grid_raw AS (
  SELECT l.*, CAST(unnest(generate_series(signup_month, end_month, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM lifecycles l),
grid AS (
  SELECT g.*,
         CASE WHEN first_paid_date IS NULL OR month < date_trunc('month', first_paid_date) THEN 'Free'
              WHEN custkey % 20 = 0 THEN 'Enterprise'
              WHEN custkey % 10 = 0 THEN 'Team'
              WHEN custkey % 7 = 0 AND month >= date_trunc('month', first_paid_date) + INTERVAL 6 MONTH THEN 'Team'
              ELSE 'Pro' END AS plan
  FROM grid_raw g),
plans AS (
  SELECT * FROM (VALUES ('Free', 0::DECIMAL(18,2), 40, NULL::DECIMAL(6,2)),
                        ('Pro', 29, 8, 0.25), ('Team', 149, 10, 0.22), ('Enterprise', 1200, 20, 0.18))
       AS t(plan, monthly_fee_usd, included_credits, overage_usd_per_credit)),
models AS (
  SELECT * FROM (VALUES ('frontier-large', 3.00::DECIMAL(8,2), 15.00::DECIMAL(8,2), 11::DOUBLE),
                        ('balanced-medium', 0.80, 4.00, 6), ('fast-small', 0.25, 1.25, 3),
                        ('open-weights-hosted', 0.15, 0.60, 4.5))
       AS t(model, usd_per_m_input, usd_per_m_output, sec_per_step)),
customers AS (
  SELECT 'C' || lpad(CAST(l.custkey AS VARCHAR), 8, '0') AS customer_id, c_name AS company_name, signup_date,
         c_mktsegment AS industry,
         CASE WHEN c_acctbal < 1000 THEN 'Startup' WHEN c_acctbal < 4000 THEN 'SMB'
              WHEN c_acctbal < 7500 THEN 'Mid-Market' ELSE 'Enterprise' END AS company_size,
         r_name AS region,
         CASE WHEN l.custkey % 10 = 0 THEN 'Outbound Sales' WHEN l.custkey % 10 <= 3 THEN 'Organic'
              WHEN l.custkey % 10 <= 5 THEN 'Paid Search' WHEN l.custkey % 10 <= 7 THEN 'Referral'
              ELSE 'Community' END AS acquisition_channel,
         l.is_sales_led, l.first_paid_date, g.plan AS current_plan,
         CASE WHEN churned THEN last_day(l.end_month) END AS churn_date,
         CASE WHEN churned THEN 'churned' ELSE 'active' END AS status
  FROM lifecycles l
  JOIN customer c ON c.c_custkey = l.custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  JOIN (SELECT custkey, plan FROM grid WHERE month = end_month) g ON g.custkey = l.custkey),
experiment_assignments AS (
  SELECT 'C' || lpad(CAST(custkey AS VARCHAR), 8, '0') AS customer_id, 'pro_price' AS experiment_name,
         signup_date AS assigned_at,
         CASE WHEN (custkey // 10) % 2 = 1 THEN 'treatment' ELSE 'control' END AS variant,
         CASE WHEN (custkey // 10) % 2 = 1 THEN 39 ELSE 29 END AS pro_price_shown
  FROM lifecycles
  WHERE is_sales_led = 0 AND signup_date BETWEEN DATE '2025-02-01' AND DATE '2025-04-30'),
agent_runs AS (
  SELECT 'R' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
             || CAST(round(l_extendedprice * 100) AS BIGINT) AS run_id,
         'C' || lpad(CAST(o.custkey AS VARCHAR), 8, '0') AS customer_id,
         CAST(o.day AS TIMESTAMP) + to_hours(l_linenumber) AS started_at,
         CAST(date_trunc('month', o.day) AS DATE) AS month,
         CASE l_partkey % 6 WHEN 0 THEN 'code_migration' WHEN 1 THEN 'bug_fix' WHEN 2 THEN 'test_generation'
              WHEN 3 THEN 'refactor' WHEN 4 THEN 'dependency_upgrade' ELSE 'feature_build' END AS task_type,
         CASE WHEN l_partkey % 6 = 0
              THEN CASE l_linenumber % 3 WHEN 0 THEN 'COBOL' WHEN 1 THEN 'PHP' ELSE '.NET Framework' END
              ELSE CASE l_suppkey % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'Java' WHEN 2 THEN 'TypeScript'
                   WHEN 3 THEN 'Go' ELSE 'C#' END END AS source_stack,
         CASE WHEN l_partkey % 6 = 0
              THEN CASE l_linenumber % 3 WHEN 0 THEN 'Java' WHEN 1 THEN 'Node.js' ELSE '.NET 8' END
              ELSE CASE l_suppkey % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'Java' WHEN 2 THEN 'TypeScript'
                   WHEN 3 THEN 'Go' ELSE 'C#' END END AS target_stack,
         m.model, g.plan AS plan_at_run,
         CAST(l_quantity AS INTEGER) AS steps,
         CAST(floor(l_extendedprice * 10) AS BIGINT) AS input_tokens,
         CAST(floor(l_extendedprice * 3) AS BIGINT) AS output_tokens,
         CAST((CAST(floor(l_extendedprice * 10) AS BIGINT) * CAST(m.usd_per_m_input * 100 AS BIGINT)
             + CAST(floor(l_extendedprice * 3) AS BIGINT) * CAST(m.usd_per_m_output * 100 AS BIGINT))
             * 0.00000001::DECIMAL(9,8) AS DECIMAL(18,8)) AS llm_cost_usd,
         CAST(l_quantity AS INTEGER) * m.sec_per_step AS latency_sec,
         CAST(l_quantity AS INTEGER) * 10 AS lines_changed,
         l_linenumber + 2 AS tests_total,
         CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 0
              WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN (l_linenumber + 2) // 2
              ELSE l_linenumber + 2 END AS tests_passed,
         CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'failed'
              WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'partial' ELSE 'success' END AS status,
         CASE l_partkey % 6 WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE 5 END
             AS credits_charged,
         CASE WHEN l_orderkey % 4 = 0
              THEN CAST(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1
                        WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 2 ELSE 3 END + l_partkey % 3 AS INTEGER)
         END AS human_rating,
         l_partkey % 15 AS task_number
  FROM lineitem
  JOIN order_days o ON o.o_orderkey = l_orderkey
  JOIN models m ON m.model = CASE l_suppkey % 4 WHEN 0 THEN 'frontier-large' WHEN 1 THEN 'balanced-medium'
                                  WHEN 2 THEN 'fast-small' ELSE 'open-weights-hosted' END
  LEFT JOIN grid g ON g.custkey = o.custkey AND g.month = date_trunc('month', o.day)),
run_month AS (
  SELECT customer_id, month, sum(llm_cost_usd) AS llm_cost_usd, sum(credits_charged) AS credits
  FROM agent_runs GROUP BY ALL),
billing AS (
  SELECT 'C' || lpad(CAST(custkey AS VARCHAR), 8, '0') AS customer_id, month, plan,
         CASE WHEN plan = 'Pro' AND is_sales_led = 0 AND (custkey // 10) % 2 = 1
                   AND signup_date BETWEEN DATE '2025-02-01' AND DATE '2025-04-30'
              THEN 39::DECIMAL(18,2) ELSE monthly_fee_usd END AS monthly_fee_usd,
         included_credits, overage_usd_per_credit
  FROM grid JOIN plans USING (plan)),
billed AS (
  SELECT b.*, CAST(coalesce(credits, 0) AS BIGINT) AS credits_used,
         CASE WHEN plan = 'Free' THEN 0 ELSE greatest(CAST(coalesce(credits, 0) AS BIGINT) - included_credits, 0) END
             AS overage_credits
  FROM billing b LEFT JOIN run_month r ON r.customer_id = b.customer_id AND r.month = b.month),
customer_months AS (
  SELECT customer_id, month, plan, monthly_fee_usd, included_credits, credits_used, overage_credits,
         CAST(overage_credits * coalesce(overage_usd_per_credit, 0) AS DECIMAL(18,2)) AS overage_revenue_usd,
         CAST(monthly_fee_usd + CAST(overage_credits * coalesce(overage_usd_per_credit, 0) AS DECIMAL(18,2))
              AS DECIMAL(18,2)) AS revenue_usd
  FROM billed),
attempts AS (
  SELECT model, 't' || task_number AS task_id, task_type, status, tests_passed, tests_total,
         CASE WHEN status = 'failed' THEN 'AssertionError' END AS error_type,
         input_tokens AS prompt_tokens, output_tokens, latency_sec AS total_duration_sec,
         latency_sec * 0.5 AS eval_duration_sec,
         CAST(output_tokens AS DOUBLE) / NULLIF(latency_sec * 0.5, 0) AS tokens_per_sec, llm_cost_usd AS cost_usd
  FROM agent_runs),
responses AS (
  SELECT conv_id || '-' || turn AS response_id, text FROM conversations WHERE role = 'assistant'),
paid AS (SELECT * FROM customer_months WHERE plan <> 'Free'),
cost_months AS (
  SELECT c.*, coalesce(r.llm_cost_usd, 0) AS llm_cost_usd
  FROM customer_months c LEFT JOIN run_month r ON r.customer_id = c.customer_id AND r.month = c.month),
first_runs AS (
  SELECT * FROM agent_runs
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY started_at, run_id) <= 5)
"""


def with_mapping(query: str, extra: str = "") -> str:
    """Prefix a SELECT with the mapping CTEs and optional further CTEs."""
    more = f",\n{extra.strip().rstrip(',')}" if extra else ""
    return f"WITH {MAPPING.strip()}{more}\n{query.strip()}"
