"""Queries for explanations (H1-H4, H9, B16, K6) on the embedding rows with
the fixed linear model of train_q."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.functions.draws import sql_uniform
from fedsight.operators import clean
from fedsight.operators import evaluate as ev
from fedsight.operators import explain as ex
from fedsight.operators import sample as sp
from fedsight.operators import train as tr
from fedsight.plans.registry import query
from fedsight.plans.train_q import D, FEATS, FIXED_B, FIXED_W, TR
from fedsight.sources import testbed as tb


def _rows(spark, d):
    return tb.training_rows(spark, d)


_CUTS = ",\n".join(
    f"""c{i} AS (SELECT 'f{i}' AS feature, quantile_cont(f{i}, 0.25) AS q1, quantile_cont(f{i}, 0.5) AS q2,
                 quantile_cont(f{i}, 0.75) AS q3 FROM training_rows)""" for i in range(D))
_LONG = " UNION ALL ".join(f"SELECT vec_id, 'f{i}' AS feature, f{i} AS value FROM training_rows" for i in range(D))
_BINS = TR + ",\n" + _CUTS + f""",
cuts AS ({' UNION ALL '.join(f'SELECT * FROM c{i}' for i in range(D))}),
lg AS ({_LONG}),
bn AS (SELECT lg.vec_id, lg.feature, lg.value,
              CAST(value > q1 AS INTEGER) + CAST(value > q2 AS INTEGER) + CAST(value > q3 AS INTEGER) AS bin, q1, q2, q3
       FROM lg JOIN cuts ON lg.feature = cuts.feature),
bins AS (SELECT vec_id, feature, value, bin,
  CASE bin WHEN 0 THEN feature || ' <= ' || printf('%.2f', q1)
           WHEN 1 THEN printf('%.2f', q1) || ' < ' || feature || ' <= ' || printf('%.2f', q2)
           WHEN 2 THEN printf('%.2f', q2) || ' < ' || feature || ' <= ' || printf('%.2f', q3)
           ELSE feature || ' > ' || printf('%.2f', q3) END AS condition FROM bn)
"""


def _bins(spark, d):
    rows = _rows(spark, d)
    return ex.quartile_bins(rows, FEATS, "vec_id", ex.quartile_cuts(rows, FEATS))


# H1
@query("quartile_bins", _BINS + "SELECT * FROM bins")
def q_bins(spark, d):
    return _bins(spark, d)


# B16
@query("base_feature_name", _BINS + """
SELECT DISTINCT feature, bin, condition, regexp_extract(condition, '([A-Za-z_][A-Za-z0-9_.#]*)', 1) AS base_feature FROM bins""")
def q_base_name(spark, d):
    return _bins(spark, d).select("feature", "bin", "condition",
                                  clean.base_feature_name("condition").alias("base_feature")).distinct()


# H4 / K6 / H9: background = 100 hash-chosen rows; explained = the same rows' first 50 by hash.
_BG = f"""bg AS (SELECT * FROM training_rows ORDER BY {sql_uniform(['vec_id'], 42)}, vec_id LIMIT 100),
mu AS (SELECT {', '.join(f'avg(f{i}) AS m{i}' for i in range(D))} FROM bg),
phi AS ({' UNION ALL '.join(
    f"SELECT t.vec_id, 'f{i}' AS feature, ({FIXED_W[i]!r}) * (t.f{i} - mu.m{i}) AS phi, "
    f"({FIXED_B!r}) + {' + '.join(f'({FIXED_W[k]!r}) * mu.m{k}' for k in range(D))} AS base_value "
    f"FROM training_rows t, mu" for i in range(D))})"""


def _phi(spark, d):
    rows = _rows(spark, d)
    bg = sp.background_sample(rows, ["vec_id"], 100, seed=42)
    return ex.linear_shap(rows, FEATS, "vec_id", FIXED_W, FIXED_B, bg)


@query("linear_shap", TR + ",\n" + _BG + "\nSELECT vec_id, feature, round(phi, 9) AS phi, round(base_value, 9) AS base_value FROM phi")
def q_linear_shap(spark, d):
    return _phi(spark, d).withColumns({"phi": F.round("phi", 9), "base_value": F.round("base_value", 9)})


@query("global_feature_importance", TR + ",\n" + _BG + "\nSELECT feature, round(avg(abs(phi)), 9) AS importance FROM phi GROUP BY 1")
def q_global_importance(spark, d):
    return ex.global_feature_importance(_phi(spark, d)).withColumn("importance", F.round("importance", 9))


@query("attribution_ranking", TR + ",\n" + _BG + """
SELECT vec_id, feature, round(phi, 9) AS phi, round(base_value, 9) AS base_value,
       CAST(row_number() OVER (PARTITION BY vec_id ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank FROM phi""")
def q_ranking(spark, d):
    return ex.attribution_ranking(_phi(spark, d), "vec_id").withColumns(
        {"phi": F.round("phi", 9), "base_value": F.round("base_value", 9)})


# G12 + H4: five misclassified rows a client with their three largest attributions.
@query("misclassified_explained", TR.rstrip() + ",\n" + _BG.rstrip() + f""",
sc AS (SELECT t.vec_id, client_id, label, CAST(1.0 / (1.0 + exp(-({' + '.join(f'({FIXED_W[i]!r}) * t.f{i}' for i in range(D))} + ({FIXED_B!r})))) > 0.5 AS INTEGER) AS pred
  FROM training_rows t),
ms AS (SELECT vec_id, client_id, label AS true_label, pred AS predicted_label,
  row_number() OVER (PARTITION BY client_id ORDER BY {sql_uniform(['client_id', 'vec_id'], 42)}, vec_id) AS rn FROM sc WHERE label <> pred),
rk AS (SELECT vec_id, feature, round(phi, 9) AS phi, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank FROM phi)
SELECT ms.vec_id, client_id, true_label, predicted_label, feature, phi, rank FROM ms LEFT JOIN rk ON ms.vec_id = rk.vec_id AND rank <= 3 WHERE rn <= 5""")
def q_misclassified_explained(spark, d):
    rows = _rows(spark, d)
    wrong = ev.misclassified_sample(tr.score_linear(rows, FEATS, FIXED_W, FIXED_B).select("vec_id", "client_id", "label", "pred"), ["vec_id"], 5)
    out = ev.explain_misclassified(wrong, _phi(spark, d), ["vec_id"], 3)
    return out.select("vec_id", "client_id", "true_label", "predicted_label", "feature", F.round("phi", 9).alias("phi"), "rank")


def _explained(spark, d):
    rows = _rows(spark, d)
    return sp.explanation_sample(rows, "client_id", "label", ["vec_id"], per_client=10, seed=42)


# H2 (rows / property check)
@query("lime_batch")
def q_lime(spark, d):
    return ex.lime_batch(_explained(spark, d), _rows(spark, d), FEATS, "vec_id", FIXED_W, FIXED_B,
                         num_samples=500, max_features=5)


# H3 (additivity check): sampled coalitions over the whole vector.
@query("kernel_shap_batch")
def q_kernel_shap(spark, d):
    rows = _rows(spark, d)
    bg = sp.background_sample(rows, ["vec_id"], 50, seed=42)
    return ex.kernel_shap_batch(_explained(spark, d), bg, FEATS, "vec_id", FIXED_W, FIXED_B)


# H3: exact Shapley values of a model that has four inputs, against the Shapley formula over all 16 coalitions in SQL.
SMALL = FEATS[:4]
SMALL_W, SMALL_B = [1.5, -2.0, 0.75, 3.0], -0.1
_EXPLAINED = f"""cl AS (SELECT client_id, count(*) AS n, sum(label) AS np FROM training_rows GROUP BY 1),
q AS (SELECT client_id, least(floor(least(10, n) * np / n), np) AS qpos,
        least(least(10, n) - floor(least(10, n) * np / n), n - np) AS qneg FROM cl),
ranked AS (SELECT t.*, row_number() OVER (PARTITION BY client_id, label ORDER BY {sql_uniform(["client_id", "vec_id"], 42)}, vec_id) AS rn
  FROM training_rows t),
inst AS (SELECT ranked.* FROM ranked JOIN q USING (client_id) WHERE rn <= CASE WHEN label = 1 THEN qpos ELSE qneg END)"""
_MIXED = " + ".join(f"({w!r}) * CASE WHEN (s & {1 << j}) <> 0 THEN i.f{j} ELSE b.f{j} END" for j, w in enumerate(SMALL_W))
_V = f"""v AS (SELECT i.vec_id, s, avg(1.0 / (1.0 + exp(-({_MIXED} + ({SMALL_B!r}))))) AS v
  FROM inst i, bg b, range(16) r(s) GROUP BY 1, 2)"""
_SHAPLEY = " UNION ALL ".join(f"""SELECT a.vec_id, 'f{j}' AS feature, round(sum((c.v - a.v)
    * CASE bit_count(a.s) WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 / 12 WHEN 2 THEN 1.0 / 12 ELSE 0.25 END), 6) AS phi
  FROM v a JOIN v c ON a.vec_id = c.vec_id AND c.s = a.s + {1 << j} WHERE (a.s & {1 << j}) = 0 GROUP BY 1""" for j in range(4))


@query("kernel_shap_exact", TR.rstrip() + ",\n" + _BG.split(",\nmu AS")[0].replace("LIMIT 100", "LIMIT 50") + ",\n" + _EXPLAINED + ",\n" + _V + f""",
phi AS ({_SHAPLEY})
SELECT phi.vec_id, feature, phi, round(e.v, 6) AS base_value, round(f.v, 6) AS prediction
FROM phi JOIN v e ON e.vec_id = phi.vec_id AND e.s = 0 JOIN v f ON f.vec_id = phi.vec_id AND f.s = 15""")
def q_kernel_shap_exact(spark, d):
    bg = sp.background_sample(_rows(spark, d), ["vec_id"], 50, seed=42)
    phi = ex.kernel_shap_batch(_explained(spark, d), bg, SMALL, "vec_id", SMALL_W, SMALL_B, exact=True)
    return phi.withColumns({c: F.round(c, 6) for c in ("phi", "base_value", "prediction")})


# H9: importance by sample size, exact Shapley values of the four-input model over 5 and 20 drawn rows.
_DRAWN = f"""inst AS (SELECT * FROM (SELECT t.*, row_number() OVER (ORDER BY {sql_uniform(["vec_id"], 42)}, vec_id) AS place FROM training_rows t) x WHERE place <= 20)"""


@query("importance_by_method", TR.rstrip() + ",\n" + _BG.split(",\nmu AS")[0].replace("LIMIT 100", "LIMIT 50") + ",\n" + _DRAWN + ",\n" + _V + f""",
phi AS ({_SHAPLEY.replace("round(sum(", "(sum(").replace("END), 6) AS phi", "END)) AS phi")})
SELECT 'shap' AS method, n AS n_samples, feature, round(avg(abs(phi)), 6) AS importance, round(stddev_samp(abs(phi)) / sqrt(count(*)), 6) AS std_error,
  count(*) AS n_rows FROM phi JOIN inst ON inst.vec_id = phi.vec_id JOIN (SELECT unnest([5, 20]) AS n) s ON place <= n GROUP BY n, feature""")
def q_importance_by_method(spark, d):
    rows = _rows(spark, d)
    bg = sp.background_sample(rows, ["vec_id"], 50, seed=42)
    out = ex.importance_by_method(rows, SMALL, "vec_id", ex.linear_scorer(SMALL_W, SMALL_B), bg, "shap", [5, 20], exact=True)
    return out.withColumns({c: F.round(c, 6) for c in ("importance", "std_error")})
