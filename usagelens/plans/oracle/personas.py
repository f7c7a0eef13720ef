"""DuckDB SQL for the persona operators: Lloyd's algorithm as a recursive query from the same MD5 starts."""

from usagelens.plans.mapping_sql import with_mapping
from usagelens.plans.oracle.analytics import MATRIX

_X = [f"x{i}" for i in range(1, 7)]
_C = [f"c{i}" for i in range(1, 7)]
_NAMES = ["avg_monthly_runs", "failure_rate", "migration_share", "activation_score", "avg_llm_cost", "lifetime_revenue_usd"]

_DISTANCE = " + ".join(f"({x} - {c}) * ({x} - {c})" for x, c in zip(_X, _C))
_MEANS = ", ".join(f"avg({x}) AS m{x}" for x in _X)
_MOVED = ", ".join(f"coalesce(m{x}, l.{c}) AS {c}" for x, c in zip(_X, _C))
_SHIFT = ", ".join(f"abs(coalesce(m{x}, l.{c}) - l.{c})" for x, c in zip(_X, _C))
_LENGTH = " + ".join(f"{x} * {x}" for x in _X)

_FITTED = f"""{MATRIX},
pts AS MATERIALIZED (SELECT customer_id, {", ".join(f"{n} AS {x}" for n, x in zip(_NAMES, _X))} FROM matrix),
ranked AS (SELECT seed, p.*, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || customer_id), customer_id) - 1 AS cluster
           FROM pts p, (SELECT unnest(range(42, 52)) AS seed)),
lloyd AS (
  SELECT k, seed, CAST(cluster AS BIGINT) AS cluster, {", ".join(f"{x} AS {c}" for x, c in zip(_X, _C))}, 0 AS turn, 1.0::DOUBLE AS shift
  FROM ranked JOIN (SELECT unnest(range(3, 7)) AS k) ON cluster < k
  UNION ALL
  (WITH near AS (SELECT k, seed, customer_id, min({{'d': {_DISTANCE}, 'c': cluster}}).c AS cluster
                 FROM lloyd, pts WHERE shift > 1e-10 AND turn < 300 GROUP BY ALL),
   means AS (SELECT k, seed, cluster, {_MEANS} FROM near JOIN pts USING (customer_id) GROUP BY ALL)
   SELECT l.k, l.seed, l.cluster, {_MOVED}, l.turn + 1,
          max(greatest({_SHIFT})) OVER (PARTITION BY l.k, l.seed)
   FROM lloyd l LEFT JOIN means m ON m.k = l.k AND m.seed = l.seed AND m.cluster = l.cluster
   WHERE l.shift > 1e-10 AND l.turn < 300)),
settled AS (SELECT * FROM lloyd QUALIFY turn = max(turn) OVER (PARTITION BY k, seed)),
labelled AS MATERIALIZED (
  SELECT k, seed, customer_id, min({{'d': {_DISTANCE}, 'c': cluster}}) AS m FROM settled, pts GROUP BY ALL),
costs AS (SELECT k, seed, sum(m.d) AS cost FROM labelled GROUP BY ALL),
chosen AS (SELECT k, min(seed) AS seed FROM (SELECT *, min(cost) OVER (PARTITION BY k) AS least FROM costs)
           WHERE cost <= least * (1 + 1e-9) GROUP BY k),
placed AS MATERIALIZED (SELECT k, customer_id, m.c AS cluster FROM labelled JOIN chosen USING (k, seed)),
held AS (SELECT k, seed, cluster, coalesce(n, 0) AS n FROM settled JOIN chosen USING (k, seed)
         LEFT JOIN (SELECT k, cluster, count(*) AS n FROM placed GROUP BY ALL) USING (k, cluster)),
groups AS (SELECT k, cluster, count(*) AS n, avg({_LENGTH}) AS length, {_MEANS} FROM placed JOIN pts USING (customer_id) GROUP BY ALL),
spread AS (SELECT p.k, p.customer_id, p.cluster = g.cluster AS own, g.n,
                  ({_LENGTH}) + length - 2 * ({" + ".join(f"{x} * m{x}" for x in _X)}) AS mean
           FROM placed p JOIN pts USING (customer_id) JOIN groups g ON g.k = p.k),
widths AS (SELECT k, customer_id, max(n) FILTER (own) AS n, min(mean) FILTER (NOT own) AS b,
                  max(mean * n / greatest(n - 1, 1)) FILTER (own) AS a FROM spread GROUP BY ALL),
silhouettes AS (SELECT k, avg(CASE WHEN n > 1 AND greatest(a, b) > 0 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0 END) AS score
                FROM widths GROUP BY k),
diagnostics AS (
  SELECT CAST(k AS INTEGER) AS k, score AS silhouette_score, string_agg(n, ',' ORDER BY cluster) AS cluster_sizes,
         min(n)::DOUBLE / sum(n) AS smallest_cluster_share, min(n)::DOUBLE / sum(n) >= 0.05::DOUBLE AS meets_min_cluster_share
  FROM held JOIN silhouettes USING (k) GROUP BY k, score)"""

_MEMBERS = f"""{_FITTED},
best AS (SELECT k, silhouette_score FROM diagnostics
         ORDER BY meets_min_cluster_share DESC,
                  CASE WHEN meets_min_cluster_share THEN silhouette_score ELSE smallest_cluster_share END DESC, k LIMIT 1),
members AS (SELECT customer_id, CAST(cluster AS INTEGER) AS cluster, {", ".join(_NAMES)}
            FROM placed JOIN best USING (k) JOIN ever USING (customer_id))"""

_PROFILE = f"""{_MEMBERS},
means_of AS (SELECT cluster, {", ".join(f"avg({n}) AS {n}" for n in _NAMES)}, count(*) AS n_customers FROM members GROUP BY cluster),
ratios AS (SELECT m.*, n_customers::DOUBLE / sum(n_customers) OVER () AS share_of_paid_customers,
                  (SELECT silhouette_score FROM best) AS silhouette_score,
                  {", ".join(f"avg({n}) OVER () AS mean_{i}" for i, n in enumerate(_NAMES))} FROM means_of m),
lead_traits AS (SELECT *, list_filter([
           CASE WHEN migration_share >= mean_2 * 1.3::DOUBLE THEN 'Migration-Heavy' END,
           CASE WHEN lifetime_revenue_usd >= mean_5 * 1.5::DOUBLE THEN 'Enterprise'
                WHEN lifetime_revenue_usd <= mean_5 * 0.5::DOUBLE THEN 'Light Self-Serve' END,
           CASE WHEN avg_monthly_runs >= mean_0 * 1.5::DOUBLE AND lifetime_revenue_usd < mean_5 * 1.5::DOUBLE THEN 'Heavy User' END],
           lambda t: t IS NOT NULL) AS t1 FROM ratios),
mid_traits AS (SELECT *, t1 || CASE WHEN failure_rate >= mean_1 * 1.3::DOUBLE THEN ['Failure-Prone']
                                    WHEN failure_rate <= mean_1 * 0.7::DOUBLE AND len(t1) < 2 THEN ['Reliable'] ELSE [] END AS t2
               FROM lead_traits),
all_traits AS (SELECT *, t2 || CASE WHEN activation_score <= mean_3 * 0.8::DOUBLE AND len(t2) < 2 THEN ['At-Risk'] ELSE [] END AS t3
               FROM mid_traits),
plain_names AS (SELECT *, CASE WHEN len(t3) = 0 THEN 'Steady Moderate User' ELSE array_to_string(t3, ' ') END AS name FROM all_traits),
numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY lifetime_revenue_usd DESC, cluster) AS place FROM plain_names),
profile AS (SELECT CASE WHEN place = 1 THEN name ELSE name || ' (Segment ' || place || ')' END AS persona_name, cluster,
                   {", ".join(_NAMES)}, n_customers, share_of_paid_customers, silhouette_score FROM numbered)"""


def _recursive(query: str, ctes: str) -> str:
    return with_mapping(query, ctes).replace("WITH", "WITH RECURSIVE", 1)


def _minmax(columns: list[str]) -> str:
    return ", ".join(f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0.5::DOUBLE) AS {c}" for c in columns)


PERSONAS = {
    "c13_choose_k": _recursive("SELECT * FROM diagnostics", _FITTED),
    "c14_personas": _recursive("SELECT * FROM members", _MEMBERS),
    "c15_name_personas": _recursive("SELECT * FROM profile", _PROFILE),
    "m11_persona_minmax": _recursive(f"SELECT persona_name, {_minmax(_NAMES[:5])} FROM profile", _PROFILE),
}
