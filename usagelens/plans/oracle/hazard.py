"""DuckDB SQL for the churn model: Newton's method as a recursive query, equations solved by Gauss-Jordan elimination."""

from usagelens.plans.mapping_sql import with_mapping
from usagelens.plans.oracle.analytics import PANEL, phi

_Z_95 = "1.959963984540054"

# elimination with pivots 1..n; a pivot's number travels as a 1 x 1 matrix, so that the list has one type
_SOLVED = """list_reduce([m] || list_transform(range(1, n + 1), lambda k: [[k::DOUBLE]]),
       lambda m, k: list_transform(m, lambda r, i: CASE WHEN i = k[1][1]::INT THEN list_transform(r, lambda v: v / r[i])
         ELSE list_transform(r, lambda v, c: v - r[k[1][1]::INT] / m[k[1][1]::INT][k[1][1]::INT] * m[k[1][1]::INT][c]) END))"""

_DESIGN = f"""{PANEL},
filled AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY customer_id, month) AS rid, customer_id, churned_event::DOUBLE AS y,
         coalesce(acquisition_channel, min(acquisition_channel) OVER ()) AS acquisition_channel, plan,
         activation_score::DOUBLE AS activation_score, tenure_months::DOUBLE AS tenure_months,
         (tenure_months * tenure_months)::DOUBLE AS tenure_months_sq, prior_month_failure_rate::DOUBLE AS prior_month_failure_rate,
         prior_month_migration_share::DOUBLE AS prior_month_migration_share, ln(prior_month_n_runs + 1) AS log_monthly_runs
  FROM panel),
numbers AS (UNPIVOT (SELECT rid, activation_score, tenure_months, tenure_months_sq, prior_month_failure_rate,
                            prior_month_migration_share, log_monthly_runs FROM filled)
            ON COLUMNS(* EXCLUDE rid) INTO NAME feature VALUE x),
channels AS (SELECT DISTINCT acquisition_channel AS label FROM filled),
plan_labels AS (SELECT DISTINCT plan AS label FROM filled),
names AS (SELECT feature FROM numbers GROUP BY 1 HAVING max(x) > min(x)
          UNION ALL SELECT 'acquisition_channel_' || label FROM channels WHERE label > (SELECT min(label) FROM channels)
          UNION ALL SELECT 'plan_' || label FROM plan_labels WHERE label > (SELECT min(label) FROM plan_labels)),
places AS MATERIALIZED (SELECT feature, row_number() OVER (ORDER BY feature) AS f FROM names),
long AS (SELECT rid, f, coalesce(x, ('acquisition_channel_' || acquisition_channel = p.feature OR 'plan_' || plan = p.feature)::INT) AS x
         FROM filled CROSS JOIN places p LEFT JOIN numbers n USING (rid, feature)),
design AS MATERIALIZED (SELECT rid, customer_id, y, list(x ORDER BY f) AS v FROM long JOIN filled USING (rid) GROUP BY ALL)"""


def _newton(rows: str, penalty: str) -> str:
    """CTEs from ``rows`` (y, v) to ``fitted`` (beta) and ``information`` (i, j, a); coefficient 1 is the intercept."""
    return f"""
x AS MATERIALIZED (SELECT y, [1.0::DOUBLE] || v AS v FROM {rows}),
size AS (SELECT max(len(v)) AS n FROM x),
cells AS (SELECT i, j FROM size, unnest(range(1, n + 1)) a(i), unnest(range(1, n + 1)) b(j)),
newton AS (
  SELECT 0 AS turn, list_transform(range(n), lambda i: 0.0::DOUBLE) AS beta, 1.0::DOUBLE AS shift FROM size
  UNION ALL
  (WITH scored AS (SELECT y, v, 1 / (1 + exp(-list_inner_product(v, beta))) AS p FROM x, newton WHERE shift > 1e-12 AND turn < 60),
   a AS (SELECT i, j, sum(p * (1 - p) * v[i] * v[j]) + CASE WHEN i = j AND i > 1 THEN {penalty} ELSE 0 END AS a FROM scored, cells GROUP BY i, j),
   g AS (SELECT i, sum(v[i] * (y - p)) - CASE WHEN i > 1 THEN {penalty} * any_value(beta[i]) ELSE 0 END AS g
         FROM scored, newton, (SELECT DISTINCT i FROM cells) GROUP BY i),
   augmented AS (SELECT list(r ORDER BY i) AS m, count(*) AS n FROM (
     SELECT i, list(a ORDER BY j) || [any_value(g)] AS r FROM a JOIN g USING (i) GROUP BY i)),
   solved AS (SELECT n, {_SOLVED} AS s FROM augmented),
   steps AS (SELECT list_transform(s, lambda r: r[n + 1]) AS step FROM solved)
   SELECT turn + 1, list_transform(beta, lambda b, i: b + step[i]), list_max(list_transform(step, lambda d: abs(d)))
   FROM newton, steps WHERE shift > 1e-12 AND turn < 60)),
fitted AS MATERIALIZED (SELECT beta FROM newton ORDER BY turn DESC LIMIT 1)"""


_TAIL = "list_reduce([z] || range(120, 0, -1)::DOUBLE[], lambda below, j: z + j / below)"
ODDS = f"""{_DESIGN},{_newton("design", "0")},
information AS (SELECT i, j, sum(p * (1 - p) * v[i] * v[j]) AS a
                FROM (SELECT v, 1 / (1 + exp(-list_inner_product(v, beta))) AS p FROM x, fitted), cells GROUP BY i, j),
beside AS (SELECT list(r ORDER BY i) AS m, count(*) AS n FROM (
  SELECT i, list(a ORDER BY j) || list_transform(range(1, (SELECT n + 1 FROM size)), lambda c: (c = i)::INT::DOUBLE) AS r
  FROM information GROUP BY i)),
inverse AS (SELECT n, {_SOLVED} AS s FROM beside),
wald AS (SELECT feature, beta[f + 1] AS coef, sqrt(s[f + 1][n + f + 1]) AS se, abs(beta[f + 1] / sqrt(s[f + 1][n + f + 1])) AS z
         FROM places, fitted, inverse),
odds AS (SELECT feature, coef, exp(coef) AS odds_ratio, exp(coef - {_Z_95} * se) AS odds_ratio_ci_low,
                exp(coef + {_Z_95} * se) AS odds_ratio_ci_high,
                2 * CASE WHEN z >= 3 THEN exp(-z * z / 2) / sqrt(2 * pi()) / {_TAIL}
                         ELSE 1 - {phi('z')} END AS p_value
         FROM wald)"""


_HELD = "('0x' || left(md5(customer_id || '|holdout'), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 < 0.25::DOUBLE"

AUC = f"""{_DESIGN},
sided AS (SELECT *, ({_HELD} AS held FROM design),
spreads AS (SELECT list(s ORDER BY f) AS s FROM (
  SELECT f, stddev_samp(v[f]) AS s FROM sided, places WHERE NOT held GROUP BY f)),
scaled AS (SELECT y, held, list_transform(v, lambda x, i: CASE WHEN s[i] > 0 THEN x / s[i] ELSE 0 END) AS v FROM sided, spreads),
train AS (SELECT y, v FROM scaled WHERE NOT held),{_newton("train", "1")},
outcomes AS (SELECT y, list_inner_product([1.0::DOUBLE] || v, beta) AS score FROM scaled, fitted WHERE held),
mid AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM outcomes),
area AS (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS holdout_roc_auc FROM mid)"""


def _recursive(query: str, ctes: str) -> str:
    return with_mapping(query, ctes).replace("WITH", "WITH RECURSIVE", 1)


HAZARD = {
    "c05_hazard_odds_ratios": _recursive("SELECT * FROM odds", ODDS),
    "c06_hazard_holdout_auc": _recursive("SELECT * FROM area", AUC),
    "c07_churn_model_summary": _recursive(
        "SELECT holdout_roc_auc, (SELECT count(*) FROM panel) AS n_panel_rows, "
        "(SELECT CAST(sum(churned_event) AS BIGINT) FROM panel) AS n_events FROM area", AUC
    ),
    "m05_strongest_driver": _recursive(
        "SELECT feature, odds_ratio, p_value, CASE WHEN p_value < 0.001::DOUBLE THEN 'p<0.001' ELSE printf('p=%.3f', p_value) END AS p_label "
        "FROM odds ORDER BY p_value < 0.05::DOUBLE DESC, abs(ln(odds_ratio)) DESC, feature DESC LIMIT 1", ODDS
    ),
}
