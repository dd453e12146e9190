import datetime as dt
import math

from pyspark.sql import functions as F

from fedsight.operators import clean
from fedsight.sources import io


def test_csv_na_tokens_and_bad_timestamps(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("ID,V,T,EXTRA\n1,,2020-01-02 10:00:00,a\n2,nan,2020-13-01,b\n3,NaN,,c\n4,NULL,2021-02-03,d\n5, 1.5 ,2020-01-01,e\n6,x,2020-01-01,f\n")
    df = io.read_csv_typed(spark, str(p), {"ID": "long", "V": "double", "T": "timestamp"}, timestamp_cols=["T"])
    assert df.columns == ["ID", "V", "T"]  # EXTRA pruned
    rows = {r["ID"]: (r["V"], r["T"]) for r in df.collect()}
    assert [rows[i][0] for i in (1, 2, 3, 4)] == [None] * 4
    assert rows[5][0] == 1.5 and rows[6][0] is None
    assert rows[2][1] is None and rows[3][1] is None
    assert rows[1][1] == dt.datetime(2020, 1, 2, 10, 0)


def test_age_birthday_rules(spark):
    rows = [(1, dt.date(1950, 6, 15), dt.datetime(2000, 6, 14)),   # day before birthday
            (2, dt.date(1950, 6, 15), dt.datetime(2000, 6, 15)),   # on birthday
            (3, dt.date(1950, 6, 15), dt.datetime(2000, 6, 16)),   # after
            (4, dt.date(1948, 2, 29), dt.datetime(2000, 2, 28)),   # leap-day birthday
            (5, dt.date(1948, 2, 29), dt.datetime(2000, 3, 1)),
            (6, dt.date(2001, 1, 1), dt.datetime(2000, 1, 1)),     # age -1
            (7, dt.date(1879, 1, 1), dt.datetime(2000, 1, 1)),     # 121
            (8, dt.date(1880, 1, 1), dt.datetime(2000, 1, 1))]     # 120
    df = spark.createDataFrame(rows, "id int, dob date, adm timestamp")
    out = df.select("id", clean.age_years("dob", "adm").alias("age"),
                    clean.in_range_or_null(clean.age_years("dob", "adm")).alias("age_ok")).orderBy("id").collect()
    assert [r["age"] for r in out] == [49, 50, 50, 51, 52, -1, 121, 120]
    assert [r["age_ok"] for r in out][5:] == [None, None, 120]


def test_iqr_clip_edge_columns(spark):
    vals = [(float(i), 5.0, None, float(i)) for i in range(1, 21)]
    vals.append((1000.0, 5.0, None, float("nan")))
    vals.append((2.0, 5.0, None, float("inf")))
    df = spark.createDataFrame(vals, "x double, const double, empty double, y double")
    out = clean.iqr_clip(df, ["x", "const", "empty", "y"]).collect()
    xs = sorted(r["x"] for r in out)
    q = sorted([float(i) for i in range(1, 21)] + [1000.0, 2.0])
    import numpy as np
    q1, q3 = np.percentile(q, 25), np.percentile(q, 75)
    assert xs[-1] == q3 + 3 * (q3 - q1)                      # outlier clipped
    assert all(r["const"] == 5.0 for r in out)               # IQR 0 -> [min, max]
    assert all(r["empty"] == 0.0 for r in out)               # undefined -> [0,1], median 0
    ys = [r["y"] for r in out]
    assert not any(math.isnan(v) or math.isinf(v) for v in ys)
    clean.verify_clean(clean.iqr_clip(df, ["x", "const", "empty", "y"]), ["x", "const", "empty", "y"])


def test_median_impute_and_sanitize(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),), (10.0,)], "v double")
    out = [r["v"] for r in clean.median_impute(df, ["v"]).collect()]
    assert out == [1.0, 3.0, 3.0, 3.0, 10.0]


def test_label_encode_sorted_with_nan(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, s string")
    out = {r["id"]: r["s"] for r in clean.label_encode(df, ["s"]).collect()}
    assert out == {1: 1, 2: 2, 3: 0, 4: 1}  # a < b < nan


def test_base_feature_name(spark):
    df = spark.createDataFrame([("age > 1.00",), ("0.50 < los <= 1.00",), ("lab_1 <= -2.00",)], "c string")
    assert [r[0] for r in df.select(clean.base_feature_name("c")).collect()] == ["age", "los", "lab_1"]


def test_label_encode_is_a_dense_rank(spark):
    df = spark.range(3000).select((F.col("id") % 997).cast("string").alias("s"), "id")
    got = {r["id"]: r["s"] for r in clean.label_encode(df, ["s"]).collect()}
    order = sorted({str(i % 997) for i in range(3000)})
    assert got == {i: order.index(str(i % 997)) for i in range(3000)}
