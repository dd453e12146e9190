"""Queries for evaluation and training analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.functions.draws import sql_uniform
from fedsight.operators import evaluate as ev
from fedsight.operators import sample as sp
from fedsight.plans.registry import query
from fedsight.sources import testbed as tb

S = tb.with_ctes(tb.SQL_SCORED)


def _auc_sql(by: list[str], src: str = "scored") -> str:
    g = ", ".join(by)
    part = f"PARTITION BY {g} " if by else ""
    sel = f"{g}, " if by else ""
    grp = f"GROUP BY {g}" if by else ""
    return f"""(SELECT {sel}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                THEN sum(pos * (nb + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc
   FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
         FROM (SELECT {sel}score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos,
                      CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS neg FROM {src} GROUP BY {sel}score) c) r
   {grp})"""


def _metrics_sql(by: list[str]) -> str:
    g = ", ".join(by)
    return S + f""",
acc AS (SELECT {g}, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM scored GROUP BY {g}),
auc AS {_auc_sql(by)}
SELECT acc.{by[0]}, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc FROM acc LEFT JOIN auc USING ({g})"""


# G1
@query("accuracy", S + "SELECT round(avg(CAST(pred = label AS DOUBLE)), 6) AS accuracy FROM scored")
def q_accuracy(spark, d):
    return ev.accuracy(tb.scored(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


# G2
@query("roc_auc", S + f"SELECT round(auc, 6) AS auc FROM {_auc_sql([])} x")
def q_roc_auc(spark, d):
    return ev.roc_auc(tb.scored(spark, d)).select(F.round("auc", 6).alias("auc"))


# G3
@query("confusion_matrix", S + " UNION ALL ".join(
    f"SELECT {a} AS actual, {p} AS predicted, count(*) FILTER (WHERE label = {a} AND pred = {p}) AS n FROM scored"
    for a in (0, 1) for p in (0, 1)))
def q_confusion(spark, d):
    return ev.confusion_matrix(tb.scored(spark, d))


# G4
@query("classification_report", S + """,
c AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS DOUBLE) AS c00,
             CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS DOUBLE) AS c01,
             CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS DOUBLE) AS c10,
             CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS DOUBLE) AS c11 FROM scored),
k AS (SELECT *,
  CASE WHEN c00 + c10 > 0 THEN c00 / (c00 + c10) ELSE 0 END AS p0, CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) ELSE 0 END AS r0,
  CASE WHEN c11 + c01 > 0 THEN c11 / (c11 + c01) ELSE 0 END AS p1, CASE WHEN c11 + c10 > 0 THEN c11 / (c11 + c10) ELSE 0 END AS r1,
  c00 + c01 AS s0, c10 + c11 AS s1 FROM c),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
                CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1, s0 + s1 AS tot FROM k)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(CASE WHEN tot > 0 THEN (c00 + c11) / tot ELSE 0 END, 6), CAST(tot AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(tot AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / tot, 6), round((r0 * s0 + r1 * s1) / tot, 6),
                 round((f0 * s0 + f1 * s1) / tot, 6), CAST(tot AS BIGINT) FROM f""")
def q_report(spark, d):
    return ev.classification_report(tb.scored(spark, d))


# G5
@query("client_metrics", _metrics_sql(["client_id"]))
def q_client_metrics(spark, d):
    return ev.metrics(tb.scored(spark, d), ["client_id"])


# G6
@query("global_metrics_by_round", _metrics_sql(["round"]))
def q_global_metrics(spark, d):
    return ev.metrics(tb.scored(spark, d), ["round"])


# Contribution score from per-(client, round) AUC over the rounds each
# client was selected in (half the clients per round).
_SEL_SQL = f"""sel AS (
  SELECT round, client_id FROM (
    SELECT *, row_number() OVER (PARTITION BY round ORDER BY {sql_uniform(['client_id', 'round'], 42)}, client_id) AS rn,
           count(*) OVER (PARTITION BY round) AS n FROM (SELECT DISTINCT client_id, round FROM scored) c) x
  WHERE rn <= GREATEST(1, floor(n * 0.5))),
cr AS (SELECT s.* FROM scored s JOIN sel ON s.client_id = sel.client_id AND s.round = sel.round),
cra AS {_auc_sql(['client_id', 'round'], 'cr')}"""


def _client_round_auc(spark, d):
    s = tb.scored(spark, d)
    sel = sp.select_clients(s, fraction=0.5, seed=42)
    cr = s.join(sel, ["client_id", "round"], "left_semi")
    return ev.roc_auc(cr, by=["client_id", "round"])


@query("contribution_score", S + "," + _SEL_SQL + """,
w AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round) AS i,
             count(*) OVER (PARTITION BY client_id) AS n FROM cra)
SELECT client_id, round(pow(0.7, max(n)) * 1.0 + sum(0.3 * coalesce(auc, 0.5) * pow(0.7, n - i)), 6) AS contribution_score,
       max(round) AS last_update, max(n) AS n_rounds
FROM w GROUP BY client_id""")
def q_contribution(spark, d):
    return ev.contribution_scores(_client_round_auc(spark, d)).withColumn(
        "contribution_score", F.round("contribution_score", 6))


# Explanations were collected from the clients with a row of high score.
@query("training_summary", S + "," + _SEL_SQL + """,
w AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round) AS i,
             count(*) OVER (PARTITION BY client_id) AS n FROM cra),
sc AS (SELECT client_id, pow(0.7, max(n)) * 1.0 + sum(0.3 * coalesce(auc, 0.5) * pow(0.7, n - i)) AS score,
              max(round) AS last_update, max(n) AS n_rounds FROM w GROUP BY client_id),
reg AS (SELECT client_id, count(*) AS data_size, bool_or(coalesce(score > 0.99, false)) AS has_explanations FROM scored GROUP BY 1)
SELECT reg.client_id, data_size, round(coalesce(score, 1.0), 6) AS contribution_score,
       coalesce(last_update, 0) AS last_update, CAST(coalesce(n_rounds, 0) AS BIGINT) AS n_rounds, has_explanations
FROM reg LEFT JOIN sc ON reg.client_id = sc.client_id""")
def q_training_summary(spark, d):
    s = tb.scored(spark, d)
    return ev.training_summary(s, _client_round_auc(spark, d), explanations=s.where("score > 0.99")).withColumn(
        "contribution_score", F.round("contribution_score", 6))


# G9
@query("client_contribution_series", S + "," + _SEL_SQL + """,
grid AS (SELECT c.client_id, r.round FROM (SELECT DISTINCT client_id FROM cra) c,
         (SELECT CAST(unnest(generate_series(1, (SELECT max(round) FROM cra))) AS INTEGER) AS round) r)
SELECT grid.client_id, grid.round, round(coalesce(cra.auc, 0.0), 6) AS auc
FROM grid LEFT JOIN cra ON grid.client_id = cra.client_id AND grid.round = cra.round""")
def q_client_series(spark, d):
    return ev.client_series(_client_round_auc(spark, d), "auc").withColumn("auc", F.round("auc", 6))


# Global accuracy/AUC per round over the selected clients' rows.
@query("training_curve", S + "," + _SEL_SQL + """,
acc AS (SELECT round, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM cr GROUP BY 1),
auc AS """ + _auc_sql(["round"], "cr") + """,
m AS (SELECT acc.round, accuracy, auc FROM acc LEFT JOIN auc USING (round))
SELECT g.round, round(coalesce(m.accuracy, 0.0), 6) AS accuracy, round(coalesce(m.auc, 0.0), 6) AS auc
FROM (SELECT CAST(unnest(generate_series(1, (SELECT max(round) FROM m))) AS INTEGER) AS round) g LEFT JOIN m ON g.round = m.round""")
def q_training_curve(spark, d):
    s = tb.scored(spark, d)
    cr = s.join(sp.select_clients(s, fraction=0.5, seed=42), ["client_id", "round"], "left_semi")
    m = ev.metrics(cr, ["round"], digits=None)
    return ev.training_curve(m, ["accuracy", "auc"]).withColumns(
        {"accuracy": F.round("accuracy", 6), "auc": F.round("auc", 6)})


# G12
_K = ", ".join(tb.SCORED_KEYS)


@query("misclassified_sample", S + f""",
w AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {sql_uniform(['client_id', *tb.SCORED_KEYS], 42)}, {_K}) AS rn
      FROM scored WHERE pred <> label)
SELECT {_K}, client_id, round, score, label AS true_label, pred AS predicted_label FROM w WHERE rn <= 5""")
def q_misclassified(spark, d):
    return ev.misclassified_sample(tb.scored(spark, d), tb.SCORED_KEYS, 5)


# Two experiments (thresholds 0.5 / 0.4), metrics by round; final = last round.
@query("final_metrics", S + """,
auc AS """ + _auc_sql(["round"]) + """,
h AS (SELECT 'threshold_0.5' AS experiment, round, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM scored GROUP BY round
      UNION ALL
      SELECT 'threshold_0.4', round, avg(CAST(CAST(score > 0.4 AS INTEGER) = label AS DOUBLE)) FROM scored GROUP BY round)
SELECT experiment, round(arg_max(accuracy, round), 6) AS final_accuracy, round(arg_max(auc, round), 6) AS final_auc, max(round) AS rounds
FROM h JOIN auc USING (round) GROUP BY 1""")
def q_final_metrics(spark, d):
    s = tb.scored(spark, d)
    a = ev.metrics(s, ["round"], digits=None).withColumn("experiment", F.lit("threshold_0.5"))
    b = (ev.metrics(s.withColumn("pred", (F.col("score") > 0.4).cast("int")), ["round"], digits=None)
         .withColumn("experiment", F.lit("threshold_0.4")))
    return ev.final_metrics(a.unionByName(b), cols=["accuracy", "auc"]).withColumns(
        {c: F.round(c, 6) for c in ("final_accuracy", "final_auc")})
