"""Feature-table queries: the flagship and its building blocks (A, B, C, D)."""

from __future__ import annotations


from fedsight.operators import features as ft
from fedsight.plans.registry import query
from fedsight.sources import testbed as tb

_CTE = tb.with_ctes(tb.SQL_ADMISSIONS, tb.SQL_PATIENTS, tb.SQL_MEASUREMENTS, tb.SQL_DIAGNOSES)


def _lab_sql(item_col, value_col, items):
    return ",\n    ".join(
        f"CAST(arg_min({value_col}, (charttime, tie1, tie2)) FILTER (WHERE {item_col} = '{k}' AND {value_col} IS NOT NULL) AS DOUBLE) AS {v}"
        for k, v in items.items())


def _prefix_sql(code_col, prefixes, pre):
    out = []
    for k, ps in prefixes.items():
        cond = " OR ".join(f"starts_with({code_col}, '{p}')" for p in ps)
        out.append(f"count(*) FILTER (WHERE {cond}) AS {pre}{k}")
    return ",\n    ".join(out)


_NUMERIC = ["age", "los", *tb.LAB_ITEMS.values(), *tb.VITAL_ITEMS.values()]

FEATURE_TABLE_SQL = _CTE + f""",
m AS (
  SELECT hadm_id,
    {_lab_sql('lab_item', 'lab_value', tb.LAB_ITEMS)},
    {_lab_sql('vital_item', 'vital_value', tb.VITAL_ITEMS)},
    max(charttime) AS dischtime
  FROM measurements GROUP BY hadm_id),
d AS (
  SELECT hadm_id, count(*) AS diagnosis_count,
    {_prefix_sql('icd9_code', tb.CODE_PREFIXES, 'has_')}
  FROM diagnoses GROUP BY hadm_id),
top AS (
  SELECT substr(icd9_code, 1, 2) AS cat, row_number() OVER (ORDER BY count(*) DESC, substr(icd9_code, 1, 2)) AS rk
  FROM diagnoses GROUP BY 1 ORDER BY 2 LIMIT 10),
pv AS (
  SELECT hadm_id, {", ".join(f"count(*) FILTER (WHERE rk = {i}) AS proc_top{i}" for i in range(1, 11))}
  FROM diagnoses JOIN top ON substr(icd9_code, 1, 2) = top.cat GROUP BY hadm_id),
base AS (
  SELECT a.hadm_id, a.expire_flag,
    CASE WHEN (year(a.admittime) - year(p.dob)
               - CAST((month(a.admittime) < month(p.dob)) OR (month(a.admittime) = month(p.dob) AND day(a.admittime) < day(p.dob)) AS INTEGER))
              BETWEEN 0 AND 120
         THEN CAST(year(a.admittime) - year(p.dob)
               - CAST((month(a.admittime) < month(p.dob)) OR (month(a.admittime) = month(p.dob) AND day(a.admittime) < day(p.dob)) AS INTEGER) AS DOUBLE) END AS age,
    CAST(epoch_us(m.dischtime) - epoch_us(a.admittime) AS DOUBLE) / 86400e6 AS los,
    {", ".join(f"m.{c}" for c in [*tb.LAB_ITEMS.values(), *tb.VITAL_ITEMS.values()])},
    coalesce(d.diagnosis_count, 0) AS diagnosis_count,
    {", ".join(f"coalesce(d.has_{k}, 0) AS has_{k}" for k in tb.CODE_PREFIXES)}
  FROM admissions a LEFT JOIN patients p ON a.subject_id = p.subject_id
  LEFT JOIN m ON a.hadm_id = m.hadm_id LEFT JOIN d ON a.hadm_id = d.hadm_id)
SELECT base.hadm_id,
  {", ".join(f"coalesce({c}, (SELECT median({c}) FROM base)) AS {c}" for c in _NUMERIC)},
  diagnosis_count, {", ".join(f"has_{k}" for k in tb.CODE_PREFIXES)},
  {", ".join(f"coalesce(pv.proc_top{i}, 0) AS proc_top{i}" for i in range(1, 11))},
  {", ".join(f"(SELECT cat FROM top WHERE rk = {i}) AS proc_top{i}_category" for i in range(1, 11))},
  CAST(expire_flag AS INTEGER) AS mortality
FROM base LEFT JOIN pv ON base.hadm_id = pv.hadm_id
"""


def build_feature_table(spark, d, admissions=None):
    return ft.feature_table(
        tb.admissions(spark, d) if admissions is None else admissions, tb.patients(spark, d), tb.measurements(spark, d), tb.diagnoses(spark, d),
        lab_items=tb.LAB_ITEMS, vital_items=tb.VITAL_ITEMS, code_prefixes=tb.CODE_PREFIXES, top_n=10, rank_names=True)


@query("feature_table", FEATURE_TABLE_SQL)
def q_feature_table(spark, d):
    return build_feature_table(spark, d)
