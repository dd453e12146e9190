"""How the reference's inputs are laid onto the shared test tables.

The reference works on hospital tables (admissions, patients, lab/chart events,
codes, prescriptions) and on explanation/importance records per client and
training round. The queries of this repository run on the driver's tables, so
each of those inputs is a documented projection of them. Every view below is a
lazy projection/aggregate of a Parquet scan, so its work grows with the data.

Each view has a Spark builder and the same definition as SQL text (used only
by the DuckDB oracles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsight.functions.draws import sql_uniform, uniform
from fedsight.sources.tables import load

# admissions <- orders: one admission per order, the patient is the customer,
# the death flag is "order finished".
def admissions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("admittime"),
        (F.col("o_orderstatus") == "F").cast("int").alias("expire_flag"))


SQL_ADMISSIONS = """admissions AS (
  SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
         CAST(o_orderstatus = 'F' AS INTEGER) AS expire_flag
  FROM orders)"""


# patients <- customer: birth date spread over 1875..2003 by a key hash, so that
# ages below 0 and above 120 occur (range checks) as do 29 February birthdays.
def patients(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.date_add(F.lit("1875-01-01").cast("date"),
                   ((F.col("c_custkey") * 7919) % 47000).cast("int")).alias("dob"))


SQL_PATIENTS = """patients AS (
  SELECT c_custkey AS subject_id,
         CAST(DATE '1875-01-01' + CAST((c_custkey * 7919) % 47000 AS INTEGER) AS DATE) AS dob
  FROM customer)"""


# measurements <- lineitem: item = line number (labs) / return flag (vitals),
# value = quantity / extended price, time = ship date; ties broken by part, supplier.
def measurements(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_linenumber").cast("string").alias("lab_item"),
        F.col("l_quantity").alias("lab_value"),
        F.col("l_returnflag").alias("vital_item"),
        F.col("l_extendedprice").alias("vital_value"),
        F.col("l_shipdate").alias("charttime"),
        F.col("l_partkey").alias("tie1"),
        F.col("l_suppkey").alias("tie2"))


SQL_MEASUREMENTS = """measurements AS (
  SELECT l_orderkey AS hadm_id, CAST(l_linenumber AS VARCHAR) AS lab_item,
         l_quantity AS lab_value, l_returnflag AS vital_item, l_extendedprice AS vital_value,
         l_shipdate AS charttime, l_partkey AS tie1, l_suppkey AS tie2
  FROM lineitem)"""

LAB_ITEMS = {str(i): f"lab_{i}" for i in range(1, 8)}
VITAL_ITEMS = {"A": "vital_a", "N": "vital_n", "R": "vital_r"}


# diagnoses <- lineitem: the part key is the code (as text).
def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_partkey").cast("string").alias("icd9_code"))


SQL_DIAGNOSES = """diagnoses AS (
  SELECT l_orderkey AS hadm_id, CAST(l_partkey AS VARCHAR) AS icd9_code FROM lineitem)"""

CODE_PREFIXES = {"c1": ["1"], "c12": ["12", "13"], "c99": ["99"]}
CODE_PATTERNS = {"p1x": ["1.0", "17"], "p5": ["5"], "p200": ["200"]}


# prescriptions <- lineitem joined to part: the drug is the part name.
def prescriptions(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), "l_partkey")
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"),
                                         F.col("p_name").alias("drug"))
    return li.join(part, "l_partkey", "left").select("hadm_id", "drug")


SQL_PRESCRIPTIONS = """prescriptions AS (
  SELECT l.l_orderkey AS hadm_id, p.p_name AS drug
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""

DRUG_CLASSES = {"HAS_RING": ["RING"], "HAS_HOT": ["HOT", "WARM"], "HAS_TOOL": ["ANVIL", "GEAR", "BOLT"]}


# importance <- lineitem joined to part: client = supplier mod 10, round = ship
# year (1995 -> 1), feature = brand, lime = mean discount - 0.05, shap = mean tax - 0.04.
def importance(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_tax", "l_shipdate")
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    j = li.join(part, "l_partkey")
    g = j.groupBy(
        F.concat(F.lit("client_"), (F.col("l_suppkey") % 10).cast("string")).alias("client_id"),
        (F.year("l_shipdate") - 1994).alias("round"),
        F.col("p_brand").alias("feature"))
    a = g.agg(F.round(F.avg("l_discount") - 0.05, 6).alias("lime"),
              F.round(F.avg("l_tax") - 0.04, 6).alias("shap"))
    return a.select("client_id", "round", F.lit("lime").alias("method"), "feature",
                    F.col("lime").alias("value")).unionByName(
        a.select("client_id", "round", F.lit("shap").alias("method"), "feature",
                 F.col("shap").alias("value")))


SQL_IMPORTANCE = """imp_src AS (
  SELECT 'client_' || CAST(l.l_suppkey % 10 AS VARCHAR) AS client_id,
         CAST(year(l.l_shipdate) - 1994 AS INTEGER) AS round, p.p_brand AS feature,
         round(avg(l.l_discount) - 0.05, 6) AS lime, round(avg(l.l_tax) - 0.04, 6) AS shap
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2, 3),
importance AS (
  SELECT client_id, round, 'lime' AS method, feature, lime AS value FROM imp_src
  UNION ALL
  SELECT client_id, round, 'shap' AS method, feature, shap AS value FROM imp_src)"""


# attribution <- lineitem joined to part: one explained instance per order,
# signed per-feature weights; lime from the discount, shap from the tax.
def attribution(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                           "l_discount", "l_tax", "l_shipdate")
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    j = li.join(part, "l_partkey")
    return j.select(
        F.concat(F.lit("client_"), (F.col("l_suppkey") % 10).cast("string")).alias("client_id"),
        (F.year("l_shipdate") - 1994).alias("round"),
        F.col("l_orderkey").alias("instance_id"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit("lime")).otherwise(F.lit("shap")).alias("method"),
        F.col("p_brand").alias("feature"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_discount") - 0.05)
         .otherwise(F.col("l_tax") - 0.04).alias("value"))


SQL_ATTRIBUTION = """attribution AS (
  SELECT 'client_' || CAST(l.l_suppkey % 10 AS VARCHAR) AS client_id,
         CAST(year(l.l_shipdate) - 1994 AS INTEGER) AS round, l.l_orderkey AS instance_id,
         CASE WHEN l.l_linenumber % 2 = 1 THEN 'lime' ELSE 'shap' END AS method,
         p.p_brand AS feature,
         CASE WHEN l.l_linenumber % 2 = 1 THEN l.l_discount - 0.05 ELSE l.l_tax - 0.04 END AS value
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


SCORED_KEYS = ["row_id_a", "row_id_b", "row_id_c", "row_id_d", "row_id_e"]


# scored <- lineitem (row key: order, line, part, supplier, ship day): label = returned, a fixed logistic score rounded to 3
# places (ties on purpose), client = supplier mod 10, round = ship year.
def scored(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    z = F.col("l_quantity") / 25.0 - 1.0 + (F.col("l_discount") - 0.05) * 10.0 + (F.col("l_tax") - 0.04) * 5.0
    score = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 3)
    return li.select(
        F.col("l_orderkey").alias("row_id_a"), F.col("l_linenumber").alias("row_id_b"),
        F.col("l_partkey").alias("row_id_c"), F.col("l_suppkey").alias("row_id_d"),
        F.unix_date(F.to_date("l_shipdate")).alias("row_id_e"),
        F.concat(F.lit("client_"), (F.col("l_suppkey") % 10).cast("string")).alias("client_id"),
        (F.year("l_shipdate") - 1994).alias("round"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score.alias("score")).withColumn("pred", (F.col("score") > 0.5).cast("int"))


SQL_SCORED = """scored AS (
  SELECT l_orderkey AS row_id_a, l_linenumber AS row_id_b, l_partkey AS row_id_c, l_suppkey AS row_id_d,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS row_id_e,
         'client_' || CAST(l_suppkey % 10 AS VARCHAR) AS client_id,
         CAST(year(l_shipdate) - 1994 AS INTEGER) AS round,
         CAST(l_returnflag = 'R' AS INTEGER) AS label,
         round(1.0 / (1.0 + exp(-(l_quantity / 25.0 - 1.0 + (l_discount - 0.05) * 10.0 + (l_tax - 0.04) * 5.0))), 3) AS score,
         CAST(round(1.0 / (1.0 + exp(-(l_quantity / 25.0 - 1.0 + (l_discount - 0.05) * 10.0 + (l_tax - 0.04) * 5.0))), 3) > 0.5 AS INTEGER) AS pred
  FROM lineitem)"""


# training rows <- embeddings: label = parity of the class, client = id mod 3.
N_EMB_FEATURES = 64   # the whole vector


def training_rows(spark: SparkSession, d: str, n_features: int = N_EMB_FEATURES) -> DataFrame:
    e = load(spark, d, "embeddings")
    return e.select(
        "vec_id",
        F.concat(F.lit("client_"), (F.col("vec_id") % 3).cast("string")).alias("client_id"),
        (F.col("label") % 2).alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n_features)])


def sql_training_rows(n_features: int = N_EMB_FEATURES) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(n_features))
    return f"""training_rows AS (
  SELECT vec_id, 'client_' || CAST(vec_id % 3 AS VARCHAR) AS client_id,
         label % 2 AS label, {cols}
  FROM embeddings)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


__all__ = ["uniform", "sql_uniform"]
