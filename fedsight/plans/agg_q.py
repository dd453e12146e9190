"""Queries for cross-client / cross-round importance aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.operators import aggregate as ag
from fedsight.operators import evaluate as ev
from fedsight.plans.eval_q import _SEL_SQL, _client_round_auc
from fedsight.plans.registry import query
from fedsight.sources import testbed as tb

IMP = tb.with_ctes(tb.SQL_IMPORTANCE)
K = ["round", "method", "feature"]


def _imp(spark, d):
    return tb.importance(spark, d)


def _r6(df, col="value", digits=6):
    return df.withColumn(col, F.round(col, digits))


def _r9(df, col="value"):
    # averages/medians of 6-decimal inputs end in an exact 5 at the 7th decimal,
    # where engines may round differently; 9 decimals keep them comparable.
    return _r6(df, col, 9)


# client_3 lacks shap in round 2 -> shap of round 2 is skipped.
@query("aggregation_gate", IMP + """,
g AS (SELECT * FROM importance WHERE NOT (client_id = 'client_3' AND round = 2 AND method = 'shap')),
pr AS (SELECT round, count(DISTINCT client_id) AS nc FROM g GROUP BY 1),
pm AS (SELECT round, method, count(DISTINCT client_id) AS nm FROM g GROUP BY 1, 2),
ok AS (SELECT pm.round, pm.method FROM pm JOIN pr ON pm.round = pr.round WHERE nc >= 10 AND nm = nc)
SELECT g.* FROM g WHERE (round, method) IN (SELECT (round, method) FROM ok)""")
def q_gate(spark, d):
    g = _imp(spark, d).where(~((F.col("client_id") == "client_3") & (F.col("round") == 2) & (F.col("method") == "shap")))
    return ag.aggregation_gate(g, min_clients=10)


_Z = """z AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd
      FROM importance WINDOW w AS (PARTITION BY round, method, feature)),
zf AS (SELECT client_id, round, method, feature, value FROM z
       WHERE n < 4 OR sd = 0 OR sd IS NULL OR abs((value - m) / sd) < 2.0)"""


# J2
@query("zscore_filter", IMP + "," + _Z + " SELECT * FROM zf")
def q_zscore(spark, d):
    return ag.zscore_filter(_imp(spark, d), 2.0)


# J3 (after the outlier filter, as the reference's aggregation does)
@query("aggregate_simple", IMP + "," + _Z + """
SELECT round, method, feature, round(avg(value), 9) AS value FROM zf GROUP BY ALL""")
def q_simple(spark, d):
    return _r9(ag.aggregate_simple(ag.zscore_filter(_imp(spark, d))))


# weights = contribution scores of the clients.
@query("aggregate_weighted", tb.with_ctes(tb.SQL_IMPORTANCE, tb.SQL_SCORED) + "," + _SEL_SQL + """,
w AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round) AS i,
             count(*) OVER (PARTITION BY client_id) AS n FROM cra),
sc AS (SELECT client_id, pow(0.7, max(n)) * 1.0 + sum(0.3 * coalesce(auc, 0.5) * pow(0.7, n - i)) AS s FROM w GROUP BY 1)
SELECT round, method, feature, round(sum(value * coalesce(s, 1.0)) / sum(coalesce(s, 1.0)), 6) AS value
FROM importance LEFT JOIN sc ON importance.client_id = sc.client_id GROUP BY ALL""")
def q_weighted(spark, d):
    st = ev.contribution_scores(_client_round_auc(spark, d))
    return _r6(ag.aggregate_weighted(_imp(spark, d), st))


# J5
@query("aggregate_median", IMP + "SELECT round, method, feature, round(median(value), 9) AS value FROM importance GROUP BY ALL")
def q_median(spark, d):
    return _r9(ag.aggregate_median(_imp(spark, d)))


# J6
@query("aggregate_trimmed", IMP + """,
t AS (SELECT round, method, feature, value, count(*) OVER w AS n,
             row_number() OVER (PARTITION BY round, method, feature ORDER BY value) AS r
      FROM importance WINDOW w AS (PARTITION BY round, method, feature))
SELECT round, method, feature, round(avg(value), 9) AS value FROM t
WHERE n < 5 OR (r > GREATEST(1, floor(n * 0.1)) AND r <= n - GREATEST(1, floor(n * 0.1)))
GROUP BY ALL""")
def q_trimmed(spark, d):
    return _r9(ag.aggregate_trimmed(_imp(spark, d)))


# Decay over the simple averages of the gated table (round 2 shap missing).
@query("temporal_decay", IMP + """,
g AS (SELECT * FROM importance WHERE NOT (client_id = 'client_3' AND round = 2 AND method = 'shap')),
pr AS (SELECT round, count(DISTINCT client_id) AS nc FROM g GROUP BY 1),
pm AS (SELECT round, method, count(DISTINCT client_id) AS nm FROM g GROUP BY 1, 2),
ok AS (SELECT pm.round, pm.method FROM pm JOIN pr ON pm.round = pr.round WHERE nc >= 10 AND nm = nc),
a AS (SELECT round, method, feature, avg(value) AS value FROM g
      WHERE (round, method) IN (SELECT (round, method) FROM ok) GROUP BY ALL),
fs AS (SELECT DISTINCT method, feature FROM a),
rs AS (SELECT method, round, row_number() OVER (PARTITION BY method ORDER BY round) AS k FROM (SELECT DISTINCT method, round FROM a) x),
grid AS (SELECT rs.method, rs.round, rs.k, fs.feature, coalesce(a.value, 0.0) AS value
         FROM rs JOIN fs ON rs.method = fs.method
         LEFT JOIN a ON a.method = rs.method AND a.round = rs.round AND a.feature = fs.feature)
SELECT cur.round, cur.method, cur.feature,
       round(sum(CASE WHEN prev.k = 1 THEN 1.0 ELSE 0.8 END * prev.value * pow(0.19999999999999996, cur.k - prev.k)), 9) AS value
FROM grid cur JOIN grid prev ON cur.method = prev.method AND cur.feature = prev.feature AND prev.k <= cur.k
GROUP BY ALL""")
def q_decay(spark, d):
    g = _imp(spark, d).where(~((F.col("client_id") == "client_3") & (F.col("round") == 2) & (F.col("method") == "shap")))
    a = ag.aggregate_simple(ag.aggregation_gate(g, min_clients=10))
    return _r9(ag.temporal_decay(a, 0.8))


_RANKS = """rk AS (SELECT round, method, client_id, feature,
             row_number() OVER (PARTITION BY round, method, client_id ORDER BY abs(value) DESC, feature) AS rnk,
             count(*) OVER (PARTITION BY round, method, client_id) AS len FROM importance),
cm AS (SELECT a.round, a.method, a.client_id AS client_a, b.client_id AS client_b, a.rnk AS rank_a, b.rnk AS rank_b,
              a.len AS len_a, b.len AS len_b
       FROM rk a JOIN rk b ON a.round = b.round AND a.method = b.method AND a.feature = b.feature AND a.client_id < b.client_id),
c AS (SELECT DISTINCT round, method, client_id FROM importance),
pairs AS (SELECT a.round, a.method, a.client_id AS client_a, b.client_id AS client_b
          FROM c a JOIN c b ON a.round = b.round AND a.method = b.method AND a.client_id < b.client_id)"""

_SPEARMAN = IMP + "," + _RANKS + """,
rr AS (SELECT *, row_number() OVER (PARTITION BY round, method, client_a, client_b ORDER BY rank_a) AS ra,
              row_number() OVER (PARTITION BY round, method, client_a, client_b ORDER BY rank_b) AS rb FROM cm),
s AS (SELECT round, method, client_a, client_b, CAST(count(*) AS DOUBLE) AS n,
             CAST(sum((ra - rb) * (ra - rb)) AS DOUBLE) AS d2 FROM rr GROUP BY ALL),
sp AS (SELECT p.round, p.method, p.client_a, p.client_b,
              coalesce(CASE WHEN n = 1 THEN 1.0 ELSE greatest(0.0, (1.0 - 6.0 * d2 / (n * (n * n - 1)) + 1.0) / 2.0) END, 0.0) AS agreement
       FROM pairs p LEFT JOIN s USING (round, method, client_a, client_b))
"""


# J8
@query("agreement_spearman", _SPEARMAN + "SELECT round, method, client_a, client_b, round(agreement, 6) AS agreement FROM sp")
def q_spearman(spark, d):
    return _r6(ag.agreement_spearman(_imp(spark, d)), "agreement")


# J9
@query("agreement_rbo", IMP + "," + _RANKS + """,
lens AS (SELECT DISTINCT round, method, client_id, len FROM rk),
num AS (SELECT round, method, client_a, client_b,
               sum((1 - 0.9) * pow(0.9, dd - 1) / dd) AS num
        FROM (SELECT *, unnest(generate_series(GREATEST(rank_a, rank_b), LEAST(len_a, len_b))) AS dd FROM cm
              WHERE GREATEST(rank_a, rank_b) <= LEAST(len_a, len_b)) x GROUP BY ALL),
pl AS (SELECT p.*, la.len AS len_a, lb.len AS len_b FROM pairs p
       JOIN lens la ON la.round = p.round AND la.method = p.method AND la.client_id = p.client_a
       JOIN lens lb ON lb.round = p.round AND lb.method = p.method AND lb.client_id = p.client_b)
SELECT pl.round, pl.method, pl.client_a, pl.client_b,
       round(CASE WHEN LEAST(len_a, len_b) = 0 THEN 0.0
                  ELSE coalesce(num.num, 0.0) / (1.0 - pow(0.9, LEAST(len_a, len_b))) END, 6) AS agreement
FROM pl LEFT JOIN num USING (round, method, client_a, client_b)""")
def q_rbo(spark, d):
    return _r6(ag.agreement_rbo(_imp(spark, d)), "agreement")


# J10
@query("agreement_matrix", _SPEARMAN + """
SELECT round, method, client_a, client_b, round(agreement, 6) AS agreement FROM sp
UNION ALL SELECT round, method, client_b, client_a, round(agreement, 6) FROM sp
UNION ALL SELECT round, method, client_id, client_id, 1.0 FROM c""")
def q_matrix(spark, d):
    imp = _imp(spark, d)
    return _r6(ag.agreement_matrix(ag.agreement_spearman(imp), imp), "agreement")


# J11
@query("round_filter", IMP + "SELECT * FROM importance WHERE round IN (2, 4)")
def q_round_filter(spark, d):
    return ag.round_filter(_imp(spark, d), [2, 4])


# J12
@query("latest_round", IMP + """
SELECT * FROM importance WHERE client_id = 'client_3'
  AND round = (SELECT max(round) FROM importance WHERE client_id = 'client_3')""")
def q_latest(spark, d):
    return ag.latest_round(_imp(spark, d), client="client_3")


# J13
@query("aggregation_metadata", IMP + """
SELECT round, count(DISTINCT client_id) AS client_count, list_sort(list(DISTINCT client_id)) AS client_ids,
       'simple_average' AS aggregation_method FROM importance GROUP BY round""")
def q_meta(spark, d):
    return ag.aggregation_metadata(_imp(spark, d), "simple_average")
