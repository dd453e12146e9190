"""The clinical sources end to end on small CSV files."""

import pytest
from pyspark.sql import functions as F

from fedsight.sources import clinical, io

FILES = {
    "ADMISSIONS": "ROW_ID,SUBJECT_ID,HADM_ID,ADMITTIME,DISCHTIME,HOSPITAL_EXPIRE_FLAG\n1,10,100,2100-01-01 00:00:00,2100-01-03 12:00:00,0\n"
                  "2,11,101,2100-02-01 00:00:00,nan,1\n3,12,102,bad,2100-01-01 00:00:00,\n",
    "PATIENTS": "SUBJECT_ID,DOB\n10,2060-06-01 00:00:00\n11,1700-01-01 00:00:00\n",
    "ICUSTAYS": "SUBJECT_ID,HADM_ID,ICUSTAY_ID\n10,100,1\n10,100,2\n11,101,3\n",
    "LABEVENTS": "SUBJECT_ID,HADM_ID,ITEMID,CHARTTIME,VALUENUM\n10,100,50912,2100-01-01 05:00:00,1.5\n10,100,50912,2100-01-01 02:00:00,0.5\n"
                 "11,101,50912,2100-02-01 01:00:00,NULL\n11,101,99999,2100-02-01 01:00:00,7\n12,102,50971,2100-01-01 00:00:00, 4.0 \n",
    "CHARTEVENTS": "SUBJECT_ID,HADM_ID,ITEMID,CHARTTIME,VALUENUM\n10,100,220045,2100-01-01 03:00:00,80\n",
    "PROCEDURES_ICD": "HADM_ID,ICD9_CODE\n100,3891\n100,3893\n100,9604\n102,9671\n",
    "DIAGNOSES_ICD": "HADM_ID,ICD9_CODE\n100,41001\n100,4280\n101,25000\n101,25001\n",
    "PRESCRIPTIONS": "HADM_ID,DRUG\n100,Vancomycin 1g\n100,Aspirin\n101,Water\n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_tables_are_typed(spark, root):
    for name, columns in clinical.TABLES.items():
        t = clinical.read_table(spark, root, name)
        assert t.columns == list(columns) and t.count() > 0


def test_feature_table(spark, root):
    got = {r["hadm_id"]: r for r in clinical.feature_table(spark, root).collect()}
    assert set(got) == {100, 101, 102}
    a = got[100]
    assert a["CREATININE"] == 0.5 and a["los"] == 2.5 and a["age"] == 39 and a["HEART_RATE"] == 80 and a["has_MI"] == 1 and a["has_CHF"] == 1
    assert a["medication_count"] == 2 and a["ANTIBIOTIC"] == 1 and a["CARDIAC"] == 1 and got[101]["ANTIBIOTIC"] == 0
    assert got[101]["age"] == 39 and got[101]["mortality"] == 1 and got[101]["has_Diabetes"] == 2      # 400 years is no age: the median
    assert got[102]["diagnosis_count"] == 0 and a["diagnosis_count"] == 2
    # Categories are counted over procedures (38 and 96 twice each), never over diagnoses (41, 42, 25).
    top = {a["proc_top1_category"]: "proc_top1", a["proc_top2_category"]: "proc_top2"}
    assert set(top) == {"38", "96"} and a["proc_top3_category"] is None
    assert (a[top["38"]], a[top["96"]], got[101][top["38"]], got[102][top["96"]]) == (2, 1, 0, 1)
    assert [got[i]["procedure_count"] for i in (100, 101, 102)] == [3, 0, 1]


def test_rich_table(spark, root):
    t = clinical.rich_feature_table(spark, root)
    assert sorted((r["hadm_id"], r["icustay_id"]) for r in t.select("hadm_id", "icustay_id").collect() if r["icustay_id"]) == [(100, 1), (100, 2), (101, 3)]
    assert dict(t.dtypes)["proc_top1_category"] == "int"


def test_stays_join_on_both_keys(spark, root, tmp_path):
    (tmp_path / "ICUSTAYS.csv").write_text("SUBJECT_ID,HADM_ID,ICUSTAY_ID\n10,100,1\n99,100,2\n11,101,3\n")
    t = clinical.rich_feature_table(spark, root)
    assert sorted((r["hadm_id"], r["icustay_id"]) for r in t.select("hadm_id", "icustay_id").collect() if r["icustay_id"]) == [(100, 1), (101, 3)]


def test_training_contract(spark):
    df = spark.createDataFrame([(1.0, 2, "x", 0), (2.0, 3, "y", 1)], "a double, b int, s string, label int")
    io.check_features(df, ["a", "b"], "label")
    for features, label, frame in ((["a", "a"], "label", df), (["a", "label"], "label", df), (["a", "s"], "label", df), (["zz"], "label", df),
                                   (["a"], "b", df), (["a"], "label", df.withColumn("label", F.lit(None).cast("int")))):
        with pytest.raises(ValueError):
            io.check_features(frame, features, label)
