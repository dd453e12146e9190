"""The eight clinical tables: typed CSV sources and the feature table on them.

Column names and types are fixed by the published clinical database; item ids,
code and drug lists come from functions/constants.py.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsight.functions import constants as K
from fedsight.operators import clean
from fedsight.operators import features as ft
from fedsight.session import cut_lineage
from fedsight.sources import io

#: The columns that are read of each table.
TABLES = {
    "ADMISSIONS": {"SUBJECT_ID": "bigint", "HADM_ID": "bigint", "ADMITTIME": "timestamp", "DISCHTIME": "timestamp", "HOSPITAL_EXPIRE_FLAG": "int"},
    "PATIENTS": {"SUBJECT_ID": "bigint", "DOB": "timestamp"},
    "ICUSTAYS": {"SUBJECT_ID": "bigint", "HADM_ID": "bigint", "ICUSTAY_ID": "bigint"},
    "LABEVENTS": {"SUBJECT_ID": "bigint", "HADM_ID": "bigint", "ITEMID": "string", "CHARTTIME": "timestamp", "VALUENUM": "double"},
    "CHARTEVENTS": {"SUBJECT_ID": "bigint", "HADM_ID": "bigint", "ITEMID": "string", "CHARTTIME": "timestamp", "VALUENUM": "double"},
    "PROCEDURES_ICD": {"HADM_ID": "bigint", "ICD9_CODE": "string"},
    "DIAGNOSES_ICD": {"HADM_ID": "bigint", "ICD9_CODE": "string"},
    "PRESCRIPTIONS": {"HADM_ID": "bigint", "DRUG": "string"},
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table from ``<root>/<NAME>.csv`` (also compressed or a folder), typed."""
    columns = TABLES[name]
    times = [c for c, t in columns.items() if t == "timestamp"]
    return io.read_csv_typed(spark, os.path.join(root, f"{name}.csv"), columns, timestamp_cols=times)


def feature_table(spark: SparkSession, root: str, top_n: int = 10, rank_names: bool = True) -> DataFrame:
    """The per-admission feature table of the clinical tables (first lab and vital
    values, procedure categories, comorbidities, age, stay, label)."""
    adm = read_table(spark, root, "ADMISSIONS").select(
        F.col("HADM_ID").alias("hadm_id"), F.col("SUBJECT_ID").alias("subject_id"), F.col("ADMITTIME").alias("admittime"),
        F.col("DISCHTIME").alias("dischtime"), F.col("HOSPITAL_EXPIRE_FLAG").alias("expire_flag"))
    pat = read_table(spark, root, "PATIENTS").select(F.col("SUBJECT_ID").alias("subject_id"), F.col("DOB").alias("dob"))
    lab = read_table(spark, root, "LABEVENTS").where(F.col("ITEMID").isin(list(K.LAB_ITEMS))).select(
        F.col("HADM_ID").alias("hadm_id"), F.col("ITEMID").alias("lab_item"), F.col("VALUENUM").alias("lab_value"),
        F.lit(None).cast("string").alias("vital_item"), F.lit(None).cast("double").alias("vital_value"), F.col("CHARTTIME").alias("charttime"))
    vital = read_table(spark, root, "CHARTEVENTS").where(F.col("ITEMID").isin(list(K.VITAL_ITEMS))).select(
        F.col("HADM_ID").alias("hadm_id"), F.lit(None).cast("string").alias("lab_item"), F.lit(None).cast("double").alias("lab_value"),
        F.col("ITEMID").alias("vital_item"), F.col("VALUENUM").alias("vital_value"), F.col("CHARTTIME").alias("charttime"))
    codes = read_table(spark, root, "DIAGNOSES_ICD").select(F.col("HADM_ID").alias("hadm_id"), F.col("ICD9_CODE").alias("icd9_code"))
    procedures = read_table(spark, root, "PROCEDURES_ICD").select(F.col("HADM_ID").alias("hadm_id"), F.col("ICD9_CODE").alias("icd9_code"))
    drugs = read_table(spark, root, "PRESCRIPTIONS").select(F.col("HADM_ID").alias("hadm_id"), F.col("DRUG").alias("drug"))
    return ft.feature_table(
        adm, pat, lab.unionByName(vital), codes, lab_items=K.LAB_ITEMS, vital_items=K.VITAL_ITEMS, code_prefixes=K.CHARLSON_PREFIXES,
        top_n=top_n, measurement_order=("charttime", "lab_value", "vital_value"), discharge_from_measurements=False,
        prescriptions=drugs, drug_classes=K.MEDICATION_CLASSES, rank_names=rank_names, procedures=procedures)


def rich_feature_table(spark: SparkSession, root: str, iqr_factor: float = K.IQR_FACTOR) -> DataFrame:
    """The feature table joined to its intensive-care stays on both keys (an
    admission with several stays has a row for each), with numeric columns
    clipped to the quartile fences, categories encoded, and verified clean."""
    stays = read_table(spark, root, "ICUSTAYS").select(F.col("SUBJECT_ID").alias("subject_id"), F.col("HADM_ID").alias("hadm_id"),
                                                       F.col("ICUSTAY_ID").alias("icustay_id"))
    owners = read_table(spark, root, "ADMISSIONS").select(F.col("HADM_ID").alias("hadm_id"), F.col("SUBJECT_ID").alias("subject_id"))
    t = feature_table(spark, root).join(owners, "hadm_id").join(stays, ["subject_id", "hadm_id"], "left").drop("subject_id")
    numeric = ["age", "los", *K.LAB_ITEMS.values(), *K.VITAL_ITEMS.values()]
    t = clean.iqr_clip(cut_lineage(t), numeric, iqr_factor)
    t = clean.label_encode(t, [c for c in t.columns if c.endswith("_category")])
    counts = t.agg(*[F.count(c).alias(c) for c in numeric]).first()
    clean.verify_clean(t, [c for c in numeric if counts[c]])
    return t
