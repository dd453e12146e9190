"""Queries for scans/sinks (A) and scalar cleaning (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsight.functions.draws import sql_uniform
from fedsight.operators import clean
from fedsight.operators import features as ft
from fedsight.operators import sample as sp
from fedsight.plans.registry import query
from fedsight.sources import io
from fedsight.sources import testbed as tb
from fedsight.sources.tables import load

R6 = 6


# A1: text -> NA tokens -> typed value. The JSON property is the text field.
@query("scan_na_normalised", """
SELECT event_id, event_type,
  TRY_CAST(CASE WHEN trim(json_extract_string(props, '$.k')) IN ('', 'nan', 'NaN', 'NULL') THEN NULL
                ELSE trim(json_extract_string(props, '$.k')) END AS DOUBLE) AS k
FROM events""")
def q_scan_na(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type",
                                        F.get_json_object("props", "$.k").alias("k"))
    return clean.typed(clean.normalise_na(e, ["k", "event_type"]), {"k": "double"})


# A1 over files: orders as CSV text (every seventh price missing, every eleventh date odd) read back typed.
@query("csv_typed_scan", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS o_totalprice,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS o_orderdate, o_orderpriority FROM orders""")
def q_csv_typed(spark, d):
    k = F.col("o_orderkey")
    text = load(spark, d, "orders").select(
        k.cast("string").alias("o_orderkey"),
        F.when(k % 14 == 0, "NaN").when(k % 7 == 0, " NULL ").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(k % 11 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("o_orderdate"),
        "o_orderpriority", F.lit('a "quoted", text').alias("not_read"))
    path = io.fresh_path(spark, "orders-csv")
    text.write.option("header", True).csv(path)
    return io.read_csv_typed(spark, path, {"o_orderkey": "long", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"},
                             timestamp_cols=["o_orderdate"])


# Restricted scan of the big table to the sampled admission keys.
_SQL_SAMPLE = tb.with_ctes(tb.SQL_ADMISSIONS) + f""",
d AS (SELECT *, {sql_uniform(['hadm_id'], 42)} AS u FROM admissions),
r AS (SELECT *, row_number() OVER (PARTITION BY expire_flag ORDER BY u, hadm_id) AS rn,
             count(*) OVER (PARTITION BY expire_flag) AS n FROM d),
sampled AS (SELECT hadm_id, subject_id, admittime, expire_flag FROM r WHERE rn <= round(n * 0.4))
"""


def _sampled(spark, d):
    return sp.stratified_subsample(tb.admissions(spark, d), "expire_flag", 0.4, ["hadm_id"], seed=42)


@query("semi_join_scan", _SQL_SAMPLE + """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_orderkey IN (SELECT hadm_id FROM sampled)""")
def q_semi_join_scan(spark, d):
    keys = _sampled(spark, d).select(F.col("hadm_id").alias("l_orderkey"))
    return ft.restrict_to_keys(load(spark, d, "lineitem"), keys, "l_orderkey",
                               ["l_linenumber", "l_quantity", "l_shipdate"])


# A3
@query("upper_columns", """
SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, c_nationkey AS C_NATIONKEY,
       c_acctbal AS C_ACCTBAL, c_mktsegment AS C_MKTSEGMENT FROM customer""")
def q_upper(spark, d):
    return clean.upper_columns(load(spark, d, "customer"))


# A4: required columns present? non-empty? nulls per required column.
@query("validate_table", """
SELECT * FROM (VALUES
  ('o_orderkey', true, (SELECT count(*) FROM orders), (SELECT count(*) FILTER (WHERE o_orderkey IS NULL) FROM orders)),
  ('o_custkey', true, (SELECT count(*) FROM orders), (SELECT count(*) FILTER (WHERE o_custkey IS NULL) FROM orders)),
  ('o_orderdate', true, (SELECT count(*) FROM orders), (SELECT count(*) FILTER (WHERE o_orderdate IS NULL) FROM orders)),
  ('o_discharge', false, (SELECT count(*) FROM orders), CAST(NULL AS BIGINT))
) t(column_name, present, n_rows, n_null)""")
def q_validate(spark, d):
    from fedsight.sources.io import validate_table
    return validate_table(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate", "o_discharge"])


# B1
@query("parse_timestamps", """
SELECT o_orderkey, TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) AS order_ts,
       TRY_CAST(o_orderpriority AS TIMESTAMP) AS priority_ts
FROM orders""")
def q_parse_ts(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("order_ts"),
                                        F.col("o_orderpriority").alias("priority_ts"))
    return clean.parse_timestamps(o, ["order_ts", "priority_ts"]).select(
        "o_orderkey", F.col("order_ts").cast("timestamp_ntz").alias("order_ts"),
        F.col("priority_ts").cast("timestamp_ntz").alias("priority_ts"))


_AGE_SQL = ("CAST(year(a.admittime) - year(p.dob) - CAST((month(a.admittime) < month(p.dob)) OR "
            "(month(a.admittime) = month(p.dob) AND day(a.admittime) < day(p.dob)) AS INTEGER) AS DOUBLE)")


def _adm_pat(spark, d):
    return ft.left_join(tb.admissions(spark, d), tb.patients(spark, d), "subject_id")


# B2
@query("age_years", tb.with_ctes(tb.SQL_ADMISSIONS, tb.SQL_PATIENTS) + f"""
SELECT a.hadm_id, p.dob, {_AGE_SQL} AS age
FROM admissions a LEFT JOIN patients p ON a.subject_id = p.subject_id""")
def q_age(spark, d):
    return _adm_pat(spark, d).select("hadm_id", "dob", clean.age_years("dob", "admittime").alias("age"))


# B3
@query("stay_days", tb.with_ctes(tb.SQL_ADMISSIONS) + """
SELECT a.hadm_id, CAST(epoch_us(m.dischtime) - epoch_us(a.admittime) AS DOUBLE) / 86400e6 AS los
FROM admissions a LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS dischtime FROM lineitem GROUP BY 1) m
  ON a.hadm_id = m.l_orderkey""")
def q_stay(spark, d):
    m = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hadm_id")).agg(F.max("l_shipdate").alias("dischtime"))
    return tb.admissions(spark, d).join(m, "hadm_id", "left").select(
        "hadm_id", clean.duration_days("admittime", "dischtime").alias("los"))


# B4
@query("range_to_null", tb.with_ctes(tb.SQL_ADMISSIONS, tb.SQL_PATIENTS) + f"""
SELECT a.hadm_id, CASE WHEN {_AGE_SQL} BETWEEN 0 AND 120 THEN {_AGE_SQL} END AS age
FROM admissions a LEFT JOIN patients p ON a.subject_id = p.subject_id""")
def q_range(spark, d):
    return _adm_pat(spark, d).select("hadm_id", clean.in_range_or_null(clean.age_years("dob", "admittime"), 0, 120).alias("age"))


# Median imputation of the first lab values per admission.
_LABS3 = {"1": "lab_1", "2": "lab_2", "3": "lab_3"}
_LAB_SQL = ",\n  ".join(
    f"CAST(arg_min(lab_value, (charttime, tie1, tie2)) FILTER (WHERE lab_item = '{k}' AND lab_value IS NOT NULL) AS DOUBLE) AS {v}"
    for k, v in _LABS3.items())
_SQL_LABS = tb.with_ctes(tb.SQL_ADMISSIONS, tb.SQL_MEASUREMENTS) + f""",
m AS (SELECT hadm_id, {_LAB_SQL} FROM measurements GROUP BY hadm_id),
base AS (SELECT a.hadm_id, m.lab_1, m.lab_2, m.lab_3 FROM admissions a LEFT JOIN m ON a.hadm_id = m.hadm_id)
"""


def _labs(spark, d):
    m = ft.first_value_pivot(tb.measurements(spark, d), "hadm_id", "lab_item", "lab_value", _LABS3,
                             ["charttime", "tie1", "tie2"])
    return tb.admissions(spark, d).select("hadm_id").join(m, "hadm_id", "left")


@query("median_impute", _SQL_LABS + """
SELECT hadm_id, coalesce(lab_1, (SELECT median(lab_1) FROM base)) AS lab_1,
       coalesce(lab_2, (SELECT median(lab_2) FROM base)) AS lab_2,
       coalesce(lab_3, (SELECT median(lab_3) FROM base)) AS lab_3 FROM base""")
def q_median_impute(spark, d):
    return clean.median_impute(_labs(spark, d), list(_LABS3.values()))


# B6
@query("zero_fill_counts", tb.with_ctes(tb.SQL_ADMISSIONS, tb.SQL_DIAGNOSES) + """
SELECT a.hadm_id, coalesce(c.DIAGNOSIS_COUNT, 0) AS DIAGNOSIS_COUNT
FROM admissions a LEFT JOIN (SELECT hadm_id, count(*) AS DIAGNOSIS_COUNT FROM diagnoses GROUP BY 1) c
  ON a.hadm_id = c.hadm_id""")
def q_zero_fill(spark, d):
    c = ft.entity_counts(tb.diagnoses(spark, d), "hadm_id", "DIAGNOSIS_COUNT")
    return clean.zero_fill(tb.admissions(spark, d).select("hadm_id").join(c, "hadm_id", "left"))


# Admissions left-joined to their line counts; rows without lines have a
# null key and are dropped; the label null -> 0.
@query("drop_null_keys", """
SELECT o.o_orderkey, c.l_orderkey, CAST(coalesce(CAST(c.flag AS INTEGER), 0) AS INTEGER) AS flag
FROM orders o LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 END) AS flag
                          FROM lineitem GROUP BY 1) c ON o.o_orderkey = c.l_orderkey
WHERE c.l_orderkey IS NOT NULL""")
def q_drop_null(spark, d):
    c = load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.lit(1))).alias("flag"))
    j = load(spark, d, "orders").select("o_orderkey").join(c, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return clean.drop_null_keys(j, ["l_orderkey"], label="flag")


# Ratios with NaN and ±inf (zero discounts) -> null -> median (0 if none).
_RAW_SQL = """raw AS (SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_discount <> 0 THEN l_tax / l_discount WHEN l_tax > 0 THEN 'inf'::DOUBLE
         WHEN l_tax < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS tax_ratio,
    CASE WHEN l_discount > 0 THEN ln(l_discount) ELSE CAST('-inf' AS DOUBLE) END AS log_discount,
    CAST(NULL AS DOUBLE) AS empty_col FROM lineitem)"""


def _raw(spark, d):
    li = load(spark, d, "lineitem")
    ratio = (F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount"))
             .when(F.col("l_tax") > 0, F.lit(float("inf")))
             .when(F.col("l_tax") < 0, F.lit(float("-inf")))
             .otherwise(F.lit(float("nan"))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", ratio.alias("tax_ratio"),
                     F.when(F.col("l_discount") > 0, F.log("l_discount")).otherwise(F.lit(float("-inf"))).alias("log_discount"),
                     F.lit(None).cast("double").alias("empty_col"))


_FIN = "CASE WHEN isfinite({c}) THEN {c} END"


@query("sanitize_numeric", "WITH " + _RAW_SQL + f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  round(coalesce({_FIN.format(c='tax_ratio')}, (SELECT median({_FIN.format(c='tax_ratio')}) FROM raw), 0.0), {R6}) AS tax_ratio,
  round(coalesce({_FIN.format(c='log_discount')}, (SELECT median({_FIN.format(c='log_discount')}) FROM raw), 0.0), {R6}) AS log_discount,
  round(coalesce(empty_col, (SELECT median(empty_col) FROM raw), 0.0), {R6}) AS empty_col
FROM raw""")
def q_sanitize(spark, d):
    cols = ["tax_ratio", "log_discount", "empty_col"]
    out = clean.median_impute(_raw(spark, d), cols, zero_if_undefined=True)
    return out.withColumns({c: F.round(c, R6) for c in cols})


# B9
@query("clip_binary", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(least(greatest(CAST(trunc(CAST(l_linenumber - 3 AS DOUBLE)) AS INTEGER), 0), 1) AS INTEGER) AS HAS_LATE_LINE
FROM lineitem""")
def q_clip_binary(spark, d):
    li = load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     clean.clip_binary(F.col("l_linenumber") - 3).alias("HAS_LATE_LINE"))


# B10
def _iqr_sql(c):
    fin = _FIN.format(c=c)
    st = f"(SELECT quantile_cont({fin}, 0.25) AS q1, quantile_cont({fin}, 0.5) AS med, quantile_cont({fin}, 0.75) AS q3, min({fin}) AS mn, max({fin}) AS mx FROM raw)"
    return f"""st_{c} AS (SELECT *, CASE WHEN q3 - q1 IS NULL OR q3 - q1 = 0 THEN mn ELSE q1 - 3.0 * (q3 - q1) END AS lo0,
                         CASE WHEN q3 - q1 IS NULL OR q3 - q1 = 0 THEN mx ELSE q3 + 3.0 * (q3 - q1) END AS hi0 FROM {st} s),
b_{c} AS (SELECT med, CASE WHEN lo0 IS NULL OR hi0 IS NULL THEN 0.0 ELSE lo0 END AS lo,
                 CASE WHEN lo0 IS NULL OR hi0 IS NULL THEN 1.0 ELSE hi0 END AS hi FROM st_{c})"""


def _iqr_val(c):
    return (f"round(least(greatest(coalesce({_FIN.format(c=c)}, (SELECT med FROM b_{c}), 0.0), (SELECT lo FROM b_{c})), "
            f"(SELECT hi FROM b_{c})), {R6}) AS {c}")


@query("iqr_clip", "WITH " + _RAW_SQL + ",\n" + ",\n".join(_iqr_sql(c) for c in ["tax_ratio", "log_discount", "empty_col"]) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_iqr_val('tax_ratio')}, {_iqr_val('log_discount')}, {_iqr_val('empty_col')}
FROM raw""")
def q_iqr(spark, d):
    cols = ["tax_ratio", "log_discount", "empty_col"]
    out = clean.iqr_clip(_raw(spark, d), cols)
    return out.withColumns({c: F.round(c, R6) for c in cols})


# B11
@query("verify_clean", "WITH " + _RAW_SQL + """
SELECT 'tax_ratio' AS column_name, count(*) FILTER (WHERE tax_ratio IS NULL OR isnan(tax_ratio)) AS n_null,
       count(*) FILTER (WHERE abs(tax_ratio) = 'inf'::DOUBLE) AS n_inf FROM raw
UNION ALL SELECT 'log_discount', count(*) FILTER (WHERE log_discount IS NULL OR isnan(log_discount)),
       count(*) FILTER (WHERE abs(log_discount) = 'inf'::DOUBLE) FROM raw
UNION ALL SELECT 'empty_col', count(*) FILTER (WHERE empty_col IS NULL OR isnan(empty_col)),
       count(*) FILTER (WHERE abs(empty_col) = 'inf'::DOUBLE) FROM raw""")
def q_verify(spark, d):
    return clean.remaining_invalid(_raw(spark, d), ["tax_ratio", "log_discount", "empty_col"])


# The same counts of a table on its way to being committed.
@query("checked_write", "WITH " + _RAW_SQL + " " + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null,
       count(*) FILTER (WHERE isnan({c})) AS n_nan, count(*) FILTER (WHERE abs({c}) = 'inf'::DOUBLE) AS n_inf FROM raw"""
                                                           for c in ["tax_ratio", "log_discount", "empty_col"]))
def q_checked_write(spark, d):
    cols = ["tax_ratio", "log_discount", "empty_col"]
    n = io.write_counted(_raw(spark, d), io.fresh_path(spark, "checked"), cols)
    rows = [(c, n["n_rows"], n[f"null_{i}"], n[f"nan_{i}"], n[f"inf_{i}"]) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "column_name string, n_rows long, n_null long, n_nan long, n_inf long")


# B12
@query("select_features", "SELECT * EXCLUDE (o_orderkey, o_custkey) FROM orders")
def q_select_features(spark, d):
    o = load(spark, d, "orders")
    return o.select(*clean.select_features(o, exclude=["O_ORDERKEY", "o_custkey"]))


# B13
@query("label_encode", """
SELECT c_custkey,
  CAST(dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS INTEGER) AS c_mktsegment
FROM customer""")
def q_label_encode(spark, d):
    return clean.label_encode(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


# B14
@query("code_prefix", tb.with_ctes(tb.SQL_DIAGNOSES) + """
SELECT hadm_id, icd9_code, substr(icd9_code, 1, 2) AS category FROM diagnoses""")
def q_code_prefix(spark, d):
    return tb.diagnoses(spark, d).withColumn("category", clean.code_prefix("icd9_code", 2))
