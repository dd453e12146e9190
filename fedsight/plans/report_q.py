"""Queries for privacy (I), importance summaries (H5-H8, H10) and report tables (K1-K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.functions.constants import PRIVACY_EPSILONS
from fedsight.functions.draws import sql_laplace, sql_uniform
from fedsight.operators import aggregate as ag
from fedsight.operators import evaluate as ev
from fedsight.operators import privacy as pv
from fedsight.operators import report as rp
from fedsight.operators import summarize as sm
from fedsight.plans.registry import query
from fedsight.sources import testbed as tb

IMP = tb.with_ctes(tb.SQL_IMPORTANCE)
ATT = tb.with_ctes(tb.SQL_ATTRIBUTION)
IK = ["client_id", "round", "method", "feature"]


def _r(df, col="value", digits=9):
    return df.withColumn(col, F.round(col, digits))


# I1
@query("clip_importance", IMP + """
SELECT client_id, round, method, feature, least(greatest(value, -0.01), 0.01) AS value FROM importance""")
def q_clip(spark, d):
    return pv.clip_importance(tb.importance(spark, d), -0.01, 0.01)


# Top-5 per list, clip to [-0.05, 0.05], Laplace noise with ε = 1.
_TOP5 = """t AS (SELECT *, CAST(row_number() OVER (PARTITION BY client_id, round, method ORDER BY abs(value) DESC, feature) AS INTEGER) AS rank
      FROM importance)"""


@query("laplace_noise", IMP + "," + _TOP5 + f"""
SELECT client_id, round, method, feature, rank,
  round(least(greatest(value, -0.05), 0.05) + {sql_laplace(sql_uniform(IK, 42), '0.1 / 1.0')}, 9) AS value
FROM t WHERE rank <= 5""")
def q_laplace(spark, d):
    top = rp.topk_importance(tb.importance(spark, d), 5)
    return _r(pv.laplace_noise(top, 1.0, IK, clip_range=(-0.05, 0.05), seed=42, deterministic=True))


# I4
def _levels_sql():
    rows = ", ".join("(CAST(NULL AS DOUBLE), 'none')" if e is None else f"(CAST({float(e)!r} AS DOUBLE), '{float(e)}')"
                     for e in PRIVACY_EPSILONS)
    return f"(VALUES {rows}) lv(epsilon, privacy_level)"


_SWEEP = IMP + f""",
sw0 AS (SELECT i.*, lv.epsilon, lv.privacy_level, least(greatest(i.value, -1.0), 1.0) AS clean_value
        FROM importance i, {_levels_sql()}),
sw1 AS (SELECT *, clean_value + CASE WHEN epsilon IS NULL THEN 0.0
                   ELSE {sql_laplace(sql_uniform([*IK, 'privacy_level'], 42), '2.0 / epsilon')} END AS released FROM sw0),
sw AS (SELECT *, row_number() OVER (PARTITION BY client_id, round, method, privacy_level ORDER BY abs(clean_value) DESC, feature) AS rank_clean,
              row_number() OVER (PARTITION BY client_id, round, method, privacy_level ORDER BY abs(released) DESC, feature) AS rank_released
       FROM sw1)
"""


def _sweep(spark, d):
    return pv.epsilon_sweep(tb.importance(spark, d), IK)


@query("epsilon_sweep", _SWEEP + """
SELECT method, privacy_level, epsilon, round(avg(abs(released - clean_value)), 6) AS mean_abs_error,
       round(avg(abs(rank_released - rank_clean)), 6) AS mean_rank_shift, count(*) AS n_values
FROM sw GROUP BY ALL""")
def q_sweep(spark, d):
    return pv.sweep_summary(_sweep(spark, d))


# Relative error per level; rows with a zero clean value have none and are skipped.
@query("privacy_impact", _SWEEP + """
SELECT privacy_level, round(avg(rel_error), 6) AS rel_error, count(*) AS n_runs FROM (
  SELECT privacy_level, CASE WHEN clean_value <> 0 THEN abs(released - clean_value) / abs(clean_value) END AS rel_error FROM sw) x
WHERE rel_error IS NOT NULL GROUP BY 1""")
def q_privacy_impact(spark, d):
    s = _sweep(spark, d).withColumn(
        "rel_error", F.when(F.col("clean_value") != 0, F.abs(F.col("released") - F.col("clean_value")) / F.abs("clean_value")))
    return ev.privacy_impact(s, "privacy_level", "rel_error").withColumn("rel_error", F.round("rel_error", 6))


# H5
@query("importance_normalised", ATT + """,
n AS (SELECT client_id, round, method, count(DISTINCT instance_id) AS n FROM attribution GROUP BY ALL),
s AS (SELECT client_id, round, method, feature, sum(abs(value)) AS s FROM attribution GROUP BY ALL),
v AS (SELECT s.*, s.s / n.n AS v FROM s JOIN n USING (client_id, round, method))
SELECT client_id, round, method, feature,
  round(CASE WHEN sum(v) OVER (PARTITION BY client_id, round, method) > 0
        THEN v / sum(v) OVER (PARTITION BY client_id, round, method) ELSE v END, 9) AS value FROM v""")
def q_norm(spark, d):
    return _r(sm.importance_normalised(tb.attribution(spark, d)))


# H6
@query("importance_mean_present", ATT + """,
per AS (SELECT client_id, round, method, feature, avg(abs(value)) AS value FROM attribution GROUP BY ALL),
fs AS (SELECT DISTINCT method, feature FROM attribution),
g AS (SELECT DISTINCT client_id, round, method FROM per),
full_list AS (SELECT g.client_id, g.round, g.method, fs.feature, coalesce(per.value, 0.0) AS value
         FROM g JOIN fs ON g.method = fs.method
         LEFT JOIN per ON per.client_id = g.client_id AND per.round = g.round AND per.method = g.method AND per.feature = fs.feature),
r AS (SELECT *, row_number() OVER (PARTITION BY client_id, round, method ORDER BY value DESC, feature) AS rk FROM full_list)
SELECT client_id, round, method, feature, round(value, 9) AS value FROM r WHERE rk <= 10""")
def q_mean_present(spark, d):
    return _r(sm.importance_mean_present(tb.attribution(spark, d), k=10))


# H7
@query("importance_per_hit", ATT + """,
nf AS (SELECT method, count(DISTINCT feature) AS nf FROM attribution GROUP BY 1),
h AS (SELECT client_id, round, method, count(*) AS h FROM attribution GROUP BY ALL),
s AS (SELECT client_id, round, method, feature, sum(abs(value)) AS s FROM attribution GROUP BY ALL)
SELECT s.client_id, s.round, s.method, s.feature,
  round(s.s / CASE WHEN s.method = 'shap' THEN h.h / nf.nf ELSE h.h END, 9) AS value
FROM s JOIN h USING (client_id, round, method) JOIN nf ON s.method = nf.method""")
def q_per_hit(spark, d):
    return _r(sm.importance_per_hit(tb.attribution(spark, d)))


# H8
@query("topk_importance", IMP + "," + _TOP5 + " SELECT * FROM t WHERE rank <= 5")
def q_topk(spark, d):
    return rp.topk_importance(tb.importance(spark, d), 5)


# H10
@query("explanation_metadata", tb.with_ctes(tb.SQL_ATTRIBUTION, tb.SQL_ADMISSIONS) + """,
inst AS (SELECT DISTINCT a.client_id, a.round, a.instance_id, ad.expire_flag AS label
         FROM (SELECT DISTINCT client_id, round, instance_id FROM attribution) a
         LEFT JOIN admissions ad ON a.instance_id = ad.hadm_id),
x AS (SELECT client_id, round, count(*) AS sample_size, round(avg(CAST(label AS DOUBLE)), 9) AS positive_ratio FROM inst GROUP BY ALL),
e AS (SELECT client_id, round, count(DISTINCT (instance_id, method)) AS explanation_count,
             count(DISTINCT CASE WHEN method = 'lime' THEN instance_id END) AS lime_count,
             count(DISTINCT CASE WHEN method = 'shap' THEN instance_id END) AS shap_count,
             count(DISTINCT feature) AS feature_count FROM attribution GROUP BY ALL)
SELECT * FROM x JOIN e USING (client_id, round)""")
def q_meta(spark, d):
    labels = tb.admissions(spark, d).select(F.col("hadm_id").alias("instance_id"), F.col("expire_flag").alias("label"))
    return sm.explanation_metadata(tb.attribution(spark, d), labels).withColumn(
        "positive_ratio", F.round("positive_ratio", 9))


# K1..K5 on the gimpal (simple average) importance per round.
_GLOB = IMP + """,
gimp AS (SELECT round, method, feature, avg(value) AS value FROM importance GROUP BY ALL)"""


def _glob(spark, d):
    return ag.aggregate_simple(tb.importance(spark, d))


@query("importance_report", _GLOB + """,
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY round, method ORDER BY abs(value) DESC, feature) AS INTEGER) AS rank FROM gimp)
SELECT round, method, rank, feature, round(value, 9) AS value, round(abs(value), 9) AS abs_value,
       CAST(sign(value) AS INTEGER) AS sign FROM r WHERE rank <= 10""")
def q_report(spark, d):
    out = rp.importance_report(_glob(spark, d), 10)
    return out.withColumns({"value": F.round("value", 9), "abs_value": F.round("abs_value", 9)})


@query("client_comparison", IMP + f""",
cl AS (SELECT round, method, client_id FROM (
         SELECT *, row_number() OVER (PARTITION BY round, method ORDER BY {sql_uniform(['client_id', 'round', 'method'], 42)}, client_id) AS r
         FROM (SELECT DISTINCT round, method, client_id FROM importance) c) x WHERE r <= 5),
top AS (SELECT * FROM (
         SELECT i.*, row_number() OVER (PARTITION BY i.round, i.method, i.client_id ORDER BY abs(i.value) DESC, i.feature) AS rank
         FROM importance i JOIN cl ON i.round = cl.round AND i.method = cl.method AND i.client_id = cl.client_id) y WHERE rank <= 10),
freq AS (SELECT round, method, feature, count(*) AS c FROM top GROUP BY ALL),
keep AS (SELECT round, method, feature FROM (
          SELECT *, row_number() OVER (PARTITION BY round, method ORDER BY c DESC, feature) AS k FROM freq) z WHERE k <= 10)
SELECT cl.round, cl.method, cl.client_id, keep.feature, coalesce(top.value, 0.0) AS importance
FROM cl JOIN keep ON cl.round = keep.round AND cl.method = keep.method
LEFT JOIN top ON top.round = cl.round AND top.method = cl.method AND top.client_id = cl.client_id AND top.feature = keep.feature""")
def q_comparison(spark, d):
    return rp.client_comparison(tb.importance(spark, d), 10, 5)


@query("client_comparison_all", IMP + """,
cl AS (SELECT DISTINCT round, method, client_id FROM importance),
top AS (SELECT * FROM (
         SELECT *, row_number() OVER (PARTITION BY round, method, client_id ORDER BY abs(value) DESC, feature) AS rank
         FROM importance) y WHERE rank <= 10),
freq AS (SELECT round, method, feature, count(*) AS c FROM top GROUP BY ALL),
keep AS (SELECT round, method, feature FROM (
          SELECT *, row_number() OVER (PARTITION BY round, method ORDER BY c DESC, feature) AS k FROM freq) z WHERE k <= 10)
SELECT cl.round, cl.method, cl.client_id, keep.feature, coalesce(top.value, 0.0) AS importance
FROM cl JOIN keep ON cl.round = keep.round AND cl.method = keep.method
LEFT JOIN top ON top.round = cl.round AND top.method = cl.method AND top.client_id = cl.client_id AND top.feature = keep.feature""")
def q_comparison_all(spark, d):
    """Every client; ``client_comparison`` keeps the five clients of the chart."""
    return rp.client_comparison(tb.importance(spark, d), 10)


@query("importance_evolution", _GLOB + """,
last AS (SELECT method, max(round) AS round FROM gimp GROUP BY 1),
feats AS (SELECT method, feature FROM (
  SELECT g.*, row_number() OVER (PARTITION BY g.method ORDER BY abs(g.value) DESC, g.feature) AS rank
  FROM gimp g JOIN last ON g.method = last.method AND g.round = last.round) x WHERE rank <= 5),
grid AS (SELECT r.method, r.round, f.feature FROM (SELECT DISTINCT method, round FROM gimp) r JOIN feats f ON r.method = f.method)
SELECT grid.method, grid.round, grid.feature, round(coalesce(gimp.value, 0.0), 9) AS value
FROM grid LEFT JOIN gimp ON gimp.method = grid.method AND gimp.round = grid.round AND gimp.feature = grid.feature""")
def q_evolution(spark, d):
    return _r(rp.importance_evolution(_glob(spark, d), 5))


@query("round_statistics", _GLOB + """
SELECT round, method, count(*) AS feature_count, count(*) FILTER (WHERE value <> 0) AS nonzero_count,
  round(avg(value), 9) AS mean_value, round(max(value), 9) AS max_value, round(min(value), 9) AS min_value
FROM gimp GROUP BY ALL""")
def q_round_stats(spark, d):
    return rp.round_statistics(_glob(spark, d), digits=9)


@query("dashboard_summary", _GLOB + """
SELECT count(DISTINCT round) AS n_rounds, max(round) AS latest_round, list_sort(list(DISTINCT method)) AS methods FROM gimp""")
def q_dashboard(spark, d):
    return rp.dashboard_summary(_glob(spark, d))
