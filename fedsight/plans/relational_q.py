"""Queries for joins (C) and per-entity / per-column aggregates (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.operators import clean
from fedsight.operators import features as ft
from fedsight.operators import sample as sp
from fedsight.plans.registry import query
from fedsight.sources import testbed as tb
from fedsight.sources.tables import load

R6 = 6


# C1
@query("left_join_dim", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name, p.p_brand
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""")
def q_left_join_dim(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return ft.left_join(li, part, "l_partkey")


# Composite key (order, line number) is not unique in lineitem: fan-out.
@query("left_join_composite", """
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_partkey AS stay_partkey
FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R') b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def q_left_join_composite(spark, d):
    li = load(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", "l_partkey")
    b = li.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber",
                                                       F.col("l_partkey").alias("stay_partkey"))
    return ft.left_join(a, b, ["l_orderkey", "l_linenumber"])


# Unordered client pairs per (round, method).
@query("client_pairs", tb.with_ctes(tb.SQL_IMPORTANCE) + """,
c AS (SELECT DISTINCT round, method, client_id FROM importance)
SELECT a.round, a.method, a.client_id AS client_a, b.client_id AS client_b
FROM c a JOIN c b ON a.round = b.round AND a.method = b.method AND a.client_id < b.client_id""")
def q_client_pairs(spark, d):
    from fedsight.operators.aggregate import client_pairs
    return client_pairs(tb.importance(spark, d))


# Split leak check on the stratified split of admissions.
_SPLIT_SQL_BODY = """
d AS (SELECT *, {u} AS u FROM admissions),
r AS (SELECT *, row_number() OVER (PARTITION BY expire_flag ORDER BY u, hadm_id) AS rn FROM d),
cc AS (SELECT expire_flag, count(*) AS n_class FROM admissions GROUP BY 1),
q0 AS (SELECT *, sum(n_class) OVER () AS n, ceil(sum(n_class) OVER () * 0.2) AS nt FROM cc),
q1 AS (SELECT *, n_class * nt / n AS ex, floor(n_class * nt / n) AS fl FROM q0),
q2 AS (SELECT *, nt - sum(fl) OVER () AS lft,
              row_number() OVER (ORDER BY ex - fl DESC, expire_flag) AS pos FROM q1),
quota AS (SELECT expire_flag, fl + CASE WHEN pos <= lft THEN 1 ELSE 0 END AS quota FROM q2),
split AS (SELECT r.hadm_id, r.subject_id, r.expire_flag,
                 CASE WHEN r.rn <= quota.quota THEN 'test' ELSE 'train' END AS split
          FROM r JOIN quota ON r.expire_flag = quota.expire_flag)
"""


def split_sql():
    from fedsight.functions.draws import sql_uniform
    return tb.with_ctes(tb.SQL_ADMISSIONS) + "," + _SPLIT_SQL_BODY.format(u=sql_uniform(["hadm_id"], 42))


def split_df(spark, d):
    return sp.stratified_split(tb.admissions(spark, d), "expire_flag", ["hadm_id"], 0.2, seed=42)


@query("split_overlap", split_sql() + """
SELECT (SELECT count(*) FROM split WHERE split = 'train') AS n_train,
       (SELECT count(*) FROM split WHERE split = 'test') AS n_test,
       (SELECT count(DISTINCT subject_id) FROM split WHERE split = 'train'
          AND subject_id IN (SELECT subject_id FROM split WHERE split = 'test')) AS n_overlap""")
def q_split_overlap(spark, d):
    s = split_df(spark, d)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    ov = ft.split_overlap(train, test, "subject_id").agg(F.count(F.lit(1)).alias("n_overlap"))
    counts = s.agg(F.count_if(F.col("split") == "train").alias("n_train"),
                   F.count_if(F.col("split") == "test").alias("n_test"))
    return counts.select("n_train", "n_test", ov.select("n_overlap").scalar().alias("n_overlap"))


# Two runs (thresholds 0.5 and 0.4 on the same scores), accuracy by round.
@query("run_comparison", tb.with_ctes(tb.SQL_SCORED) + """,
a AS (SELECT round, avg(CAST(pred = label AS DOUBLE)) AS acc FROM scored GROUP BY 1),
b AS (SELECT round, avg(CAST(CAST(score > 0.4 AS INTEGER) = label AS DOUBLE)) AS acc FROM scored GROUP BY 1)
SELECT a.round, round(a.acc, 6) AS accuracy_a, round(b.acc, 6) AS accuracy_b, round(b.acc - a.acc, 6) AS delta
FROM a JOIN b ON a.round = b.round""")
def q_run_comparison(spark, d):
    from fedsight.operators.evaluate import compare_runs
    s = tb.scored(spark, d)
    a = s.groupBy("round").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))
    b = s.groupBy("round").agg(F.avg(((F.col("score") > 0.4).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
    return compare_runs(a, b, "round", "accuracy")


# D1
_ITEMS = {**tb.LAB_ITEMS}


@query("first_value_pivot", tb.with_ctes(tb.SQL_MEASUREMENTS) + """
SELECT hadm_id, """ + ",\n  ".join(
    f"CAST(arg_min(lab_value, (charttime, tie1, tie2)) FILTER (WHERE lab_item = '{k}' AND lab_value IS NOT NULL) AS DOUBLE) AS {v}"
    for k, v in _ITEMS.items()) + """
FROM measurements GROUP BY hadm_id""")
def q_first_value(spark, d):
    return ft.first_value_pivot(tb.measurements(spark, d), "hadm_id", "lab_item", "lab_value", _ITEMS,
                                ["charttime", "tie1", "tie2"])


# D2
@query("entity_counts", tb.with_ctes(tb.SQL_DIAGNOSES) + """
SELECT hadm_id, count(*) AS diagnosis_count FROM diagnoses GROUP BY hadm_id""")
def q_entity_counts(spark, d):
    return ft.entity_counts(tb.diagnoses(spark, d), "hadm_id", "diagnosis_count")


# D3
@query("top_categories", tb.with_ctes(tb.SQL_DIAGNOSES) + """
SELECT substr(icd9_code, 1, 2) AS category, count(*) AS n FROM diagnoses
GROUP BY 1 ORDER BY n DESC, category LIMIT 10""")
def q_top_categories(spark, d):
    return ft.top_categories(tb.diagnoses(spark, d), clean.code_prefix("icd9_code", 2), 10)


# Crosstab of the 20 most frequent categories (entities with codes only), named by rank.
@query("category_crosstab", tb.with_ctes(tb.SQL_DIAGNOSES).rstrip() + f""",
top AS (SELECT substr(icd9_code, 1, 2) AS cat, row_number() OVER (ORDER BY count(*) DESC, substr(icd9_code, 1, 2)) AS rk
  FROM diagnoses GROUP BY 1 ORDER BY 2 LIMIT 20)
SELECT hadm_id, {", ".join(f"count(*) FILTER (WHERE rk = {i}) AS PROC_TOP{i}" for i in range(1, 21))},
  {", ".join(f"(SELECT cat FROM top WHERE rk = {i}) AS PROC_TOP{i}_category" for i in range(1, 21))}
FROM diagnoses LEFT JOIN top ON substr(icd9_code, 1, 2) = top.cat GROUP BY hadm_id""")
def q_crosstab(spark, d):
    dg = tb.diagnoses(spark, d)
    cat = clean.code_prefix("icd9_code", 2)
    top = ft.top_category_values(dg, cat, 20)
    return ft.category_crosstab(dg, "hadm_id", cat, top, "PROC_TOP", ranks=20)


# D5
def _prefix_sql():
    out = []
    for k, ps in tb.CODE_PREFIXES.items():
        cond = " OR ".join(f"starts_with(icd9_code, '{p}')" for p in ps)
        out.append(f"count(*) FILTER (WHERE {cond}) AS HAS_{k}")
    return ", ".join(out)


@query("code_prefix_counts", tb.with_ctes(tb.SQL_DIAGNOSES) + f"""
SELECT hadm_id, {_prefix_sql()} FROM diagnoses GROUP BY hadm_id""")
def q_prefix_counts(spark, d):
    return tb.diagnoses(spark, d).groupBy("hadm_id").agg(*ft.prefix_count_exprs("icd9_code", tb.CODE_PREFIXES))


# D6
def _regex_sql():
    import re
    out = []
    for k, cs in tb.CODE_PATTERNS.items():
        pat = "^(" + "|".join(re.escape(c) for c in cs) + ")"
        out.append(f"CAST(max(CAST(regexp_matches(icd9_code, '{pat}') AS INTEGER)) AS INTEGER) AS HAS_{k}")
    return ", ".join(out)


@query("code_regex_flags", tb.with_ctes(tb.SQL_DIAGNOSES) + f"""
SELECT hadm_id, {_regex_sql()} FROM diagnoses GROUP BY hadm_id""")
def q_regex_flags(spark, d):
    return tb.diagnoses(spark, d).groupBy("hadm_id").agg(*ft.regex_flag_exprs("icd9_code", tb.CODE_PATTERNS))


# D7
def _kw_sql():
    out = []
    for k, ws in tb.DRUG_CLASSES.items():
        cond = " OR ".join(f"contains(lower(drug), '{w.lower()}')" for w in ws)
        out.append(f"CAST(max(CAST(coalesce({cond}, false) AS INTEGER)) AS INTEGER) AS {k}")
    return ", ".join(out)


@query("keyword_flags", tb.with_ctes(tb.SQL_PRESCRIPTIONS) + f"""
SELECT hadm_id, count(*) AS medication_count, {_kw_sql()} FROM prescriptions GROUP BY hadm_id""")
def q_keyword_flags(spark, d):
    return tb.prescriptions(spark, d).groupBy("hadm_id").agg(
        ft.count_expr("medication_count"), *ft.keyword_flag_exprs("drug", tb.DRUG_CLASSES))


# D8
@query("class_balance", """
SELECT o_orderpriority, count(*) AS n_rows, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS n_positive,
       round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS positive_rate
FROM orders GROUP BY 1""")
def q_class_balance(spark, d):
    a = tb.admissions(spark, d).join(load(spark, d, "orders").select(F.col("o_orderkey").alias("hadm_id"), "o_orderpriority"), "hadm_id")
    return ft.class_balance(a, "expire_flag", ["o_orderpriority"]).withColumn("positive_rate", F.round("positive_rate", R6))


# D9
@query("missing_counts", tb.with_ctes(tb.SQL_ADMISSIONS, tb.SQL_MEASUREMENTS) + """,
m AS (SELECT hadm_id, """ + ",\n  ".join(
    f"CAST(arg_min(lab_value, (charttime, tie1, tie2)) FILTER (WHERE lab_item = '{k}' AND lab_value IS NOT NULL) AS DOUBLE) AS {v}"
    for k, v in _ITEMS.items()) + """ FROM measurements GROUP BY hadm_id),
b AS (SELECT a.hadm_id, """ + ", ".join(f"m.{v}" for v in _ITEMS.values()) + """ FROM admissions a LEFT JOIN m ON a.hadm_id = m.hadm_id)
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS column_name, count(*) FILTER (WHERE {v} IS NULL) AS n_missing FROM b" for v in _ITEMS.values()) + """)
WHERE n_missing > 0""")
def q_missing(spark, d):
    m = q_first_value(spark, d)
    b = tb.admissions(spark, d).select("hadm_id").join(m, "hadm_id", "left")
    return ft.missing_counts(b, list(_ITEMS.values()))


# D10
_DESC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_columns", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM lineitem""" for c in _DESC))
def q_describe(spark, d):
    return ft.describe_columns(load(spark, d, "lineitem"), _DESC)


# D11
@query("histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 END AS width FROM s),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / width), 29) AS INTEGER) AS bin, lo, width
      FROM lineitem, w WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(any_value(lo) + bin * any_value(width), 6) AS bin_lo,
       round(any_value(lo) + (bin + 1) * any_value(width), 6) AS bin_hi, count(*) AS n
FROM b GROUP BY bin""")
def q_histogram(spark, d):
    return ft.histogram(load(spark, d, "lineitem"), "l_extendedprice", 30)


# D12
@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in _DESC for b in _DESC))
def q_corr(spark, d):
    return ft.correlation_matrix(load(spark, d, "lineitem"), _DESC)


# D13
@query("value_counts", "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1")
def q_value_counts(spark, d):
    return ft.value_counts(load(spark, d, "lineitem"), "l_returnflag")
