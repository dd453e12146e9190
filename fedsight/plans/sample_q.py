"""Queries for sampling, splitting and client partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.functions.draws import sql_uniform
from fedsight.operators import sample as sp
from fedsight.plans.registry import query
from fedsight.plans.relational_q import split_df, split_sql
from fedsight.sources import testbed as tb

U_ADM = sql_uniform(["hadm_id"], 42)


# E1
@query("stratified_subsample", tb.with_ctes(tb.SQL_ADMISSIONS) + f""",
d AS (SELECT *, {U_ADM} AS u FROM admissions),
r AS (SELECT *, row_number() OVER (PARTITION BY expire_flag ORDER BY u, hadm_id) AS rn,
             count(*) OVER (PARTITION BY expire_flag) AS n FROM d)
SELECT hadm_id, subject_id, admittime, expire_flag FROM r WHERE rn <= round(n * 0.4)""")
def q_stratified_subsample(spark, d):
    return sp.stratified_subsample(tb.admissions(spark, d), "expire_flag", 0.4, ["hadm_id"], seed=42)


# E2
@query("stratified_split", split_sql() + "SELECT * FROM split")
def q_stratified_split(spark, d):
    return split_df(spark, d).select("hadm_id", "subject_id", "expire_flag", "split")


# Explanation sample per client of the scored lines (k=10); with the
# privacy gate on and min_samples = 5000 clients with fewer rows are suppressed.
def _expl_sql(per_client, min_samples=None):
    gate = f"WHERE LEAST({per_client}, n) >= {min_samples}" if min_samples is not None else ""
    return tb.with_ctes(tb.SQL_SCORED) + f""",
c AS (SELECT client_id, count(*) AS n, sum(label) AS np FROM scored GROUP BY 1),
q AS (SELECT client_id, LEAST({per_client}, n) AS k,
             LEAST(floor(LEAST({per_client}, n) * np / n), np) AS qpos,
             LEAST(LEAST({per_client}, n) - floor(LEAST({per_client}, n) * np / n), n - np) AS qneg FROM c {gate}),
d AS (SELECT *, {sql_uniform(['client_id', *tb.SCORED_KEYS], 42)} AS u FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY client_id, label ORDER BY u, {', '.join(tb.SCORED_KEYS)}) AS rn FROM d)
SELECT {', '.join('r.' + k for k in tb.SCORED_KEYS)}, r.client_id, r.round, r.label, r.score, r.pred
FROM r JOIN q ON r.client_id = q.client_id
WHERE r.rn <= CASE WHEN r.label = 1 THEN q.qpos ELSE q.qneg END"""


def _expl(spark, d, per_client, min_samples=None, privacy=False):
    return sp.explanation_sample(tb.scored(spark, d), "client_id", "label", tb.SCORED_KEYS,
                                 per_client=per_client, min_samples=min_samples, privacy=privacy, seed=42)


@query("explanation_sample", _expl_sql(10))
def q_explanation_sample(spark, d):
    return _expl(spark, d, 10)


@query("min_sample_gate", _expl_sql(6000, 5000))
def q_min_sample_gate(spark, d):
    return _expl(spark, d, 6000, min_samples=5000, privacy=True)


# E4
@query("balanced_sample", tb.with_ctes(tb.SQL_ADMISSIONS) + f""",
m AS (SELECT LEAST(1000 // 2, count(*) FILTER (WHERE expire_flag = 1), count(*) FILTER (WHERE expire_flag = 0)) AS m FROM admissions),
d AS (SELECT *, {U_ADM} AS u FROM admissions WHERE expire_flag IN (0, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY expire_flag ORDER BY u, hadm_id) AS rn FROM d)
SELECT hadm_id, subject_id, admittime, expire_flag FROM r WHERE rn <= (SELECT m FROM m)""")
def q_balanced(spark, d):
    return sp.balanced_sample(tb.admissions(spark, d), "expire_flag", ["hadm_id"], 1000, seed=42)


# E5: Dirichlet(1) shares for 3 clients; contiguous slices in admission order.
def _partition_sql():
    shares = sp.client_shares(3, 42)
    n = "(SELECT count(*) FROM admissions)"
    e1 = f"floor({n} * {shares[0]!r})"
    e2 = f"{e1} + floor({n} * {shares[1]!r})"
    return tb.with_ctes(tb.SQL_ADMISSIONS) + f""",
r AS (SELECT *, row_number() OVER (ORDER BY hadm_id) AS rn FROM admissions)
SELECT hadm_id, subject_id, admittime, expire_flag,
  CASE WHEN rn <= {e1} THEN 'client_1' WHEN rn <= {e2} THEN 'client_2' ELSE 'client_3' END AS client_id
FROM r"""


@query("partition_clients", _partition_sql())
def q_partition_clients(spark, d):
    return sp.partition_clients(tb.admissions(spark, d), ["hadm_id"], 3, seed=42)


# Per round half of the clients (of those active in the round).
@query("select_clients", tb.with_ctes(tb.SQL_SCORED) + f""",
c AS (SELECT DISTINCT client_id, round FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY {sql_uniform(['client_id', 'round'], 42)}, client_id) AS rn,
             count(*) OVER (PARTITION BY round) AS n FROM c)
SELECT round, client_id FROM r WHERE rn <= GREATEST(1, floor(n * 0.5))""")
def q_select_clients(spark, d):
    return sp.select_clients(tb.scored(spark, d), fraction=0.5, seed=42)


# 3 clients each draw 500 admissions without replacement (overlap allowed).
@query("overlapping_clients", tb.with_ctes(tb.SQL_ADMISSIONS) + f""",
x AS (SELECT a.*, c.client_id FROM admissions a, (VALUES ('client_1'), ('client_2'), ('client_3')) c(client_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {sql_uniform(['client_id', 'hadm_id'], 42)}, hadm_id) AS rn FROM x)
SELECT hadm_id, subject_id, admittime, expire_flag, client_id FROM r WHERE rn <= 500""")
def q_overlapping(spark, d):
    return sp.overlapping_clients(tb.admissions(spark, d), ["hadm_id"], 3, 500, seed=42)


# E8
@query("background_sample", tb.with_ctes(tb.SQL_ADMISSIONS) + f"""
SELECT hadm_id, subject_id, admittime, expire_flag FROM admissions ORDER BY {U_ADM}, hadm_id LIMIT 100""")
def q_background(spark, d):
    return sp.background_sample(tb.admissions(spark, d), ["hadm_id"], 100, seed=42)


# E9
@query("validation_holdout", tb.with_ctes(tb.SQL_ADMISSIONS) + """,
r AS (SELECT *, row_number() OVER (ORDER BY hadm_id) AS rn FROM admissions)
SELECT hadm_id, subject_id, admittime, expire_flag,
       rn > floor((SELECT count(*) FROM admissions) * 0.8) AS is_validation FROM r""")
def q_holdout(spark, d):
    return sp.validation_holdout(tb.admissions(spark, d), ["hadm_id"], 0.2)


# F1
@query("class_weights", tb.with_ctes(tb.SQL_ADMISSIONS) + """,
c AS (SELECT expire_flag, count(*) AS n_class FROM admissions GROUP BY 1)
SELECT expire_flag, n_class, round(sum(n_class) OVER () / (count(*) OVER () * n_class), 6) AS weight FROM c""")
def q_class_weights(spark, d):
    return sp.class_weights(tb.admissions(spark, d), "expire_flag").withColumn("weight", F.round("weight", 6))
